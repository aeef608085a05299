"""Sharding by sampled splitters, with DataFrame functions only.

1. Every record becomes a slim row (size, text key, doc_id); equal ones become one
   row with their number. Texts are read once and never shuffled.
2. A size-weighted Poisson sample of the keys is drawn; its quantiles are the
   splitters of ``shards * ranges_per_shard`` key ranges. A key with more rows than a mean range
   gets a range of its own, between splitters of its own.
3. Ranges that hold more than twice the mean, or ``part_rows``, rows are subdivided: by key, and a range of one
   key by the hash of doc_id, both in order.
4. Exact totals of the parts give every part its offset; a running sum within the part
   gives each record its exact place in the order of (key, hash of doc_id, doc_id), and
   the law turns places into shards.

The order is a property of the rows: splitters only deal out the work, so another sample, other
file splits or other parts give the same shards. Equal texts have equal keys and stand side by
side, so a group of copies is cut only where a shard ends. Under ``bytes`` a record belongs to the
shard in which its middle byte falls: shards differ by about one record. Under ``rows`` counts
differ by one at most.

Nulls: a null text has no bytes (size 16, crc 0); a null doc_id is a key like any
other. Repeated rows are separate records that follow one another. An empty table gives an
empty result. A very long text is one row whose size counts. Other columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ROW_OVERHEAD = 16
CELL_BITS = 12
PART_ROWS = 1_000_000
COPIES = 100_000
WHOLE = 2.0**64


def order_key(text: Column) -> Column:
    """Half of the MD5 checksum as a signed number: an order that any other engine can tell too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")


def slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        order_key(text).alias("key"),
    )
    return rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("m")).withColumn("tie", F.coalesce(order_key(F.col("doc_id").cast("string")), F.lit(0)))


def splitters(rows: DataFrame, total: int, ranges: int, per_range: int) -> list[int]:
    """Quantiles of a size-weighted key sample of about ranges * per_range rows."""
    rate = ranges * per_range / max(total, 1)
    drawn = F.pmod(F.xxhash64("key", "tie"), F.lit(1 << 30)) < F.col("size") * F.col("m") * F.lit(rate * (1 << 30))
    fractions = F.array([F.lit(i / ranges) for i in range(1, ranges)])
    got = rows.where(drawn).agg(F.percentile_approx("key", fractions, F.lit(ranges * 10)).alias("q")).first()["q"]
    return sorted(set(got or []))


def hot_keys(rows: DataFrame, least: int) -> list[int]:
    """Keys of more than ``least`` rows: fewer than n / least, whatever the data."""
    return [r["key"] for r in rows.groupBy("key").agg(F.sum("m").alias("n")).where(F.col("n") > least).select("key").collect()]


def range_of(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Add ``range``, the number of splitters below the key, and the splitters ``low`` and ``high`` about it.

    The splitters lie in 2**CELL_BITS cells of the key space; each row looks only at its own
    cell's, so the small side has that many rows whatever the data.
    """
    spark = rows.sparkSession
    shift, half = 64 - CELL_BITS, 1 << (CELL_BITS - 1)
    edge = [-(1 << 63), *bounds, (1 << 63) - 1]
    cells = []
    for cell in range(-half, half):
        low, high = bisect.bisect_left(bounds, cell << shift), bisect.bisect_left(bounds, (cell + 1) << shift)
        cells.append((cell, low, edge[low : high + 2]))
    small = spark.createDataFrame(cells, "cell long, before int, edges array<long>")
    inside = F.size(F.filter("edges", lambda b: b < F.col("key"))) - F.when(F.get("edges", F.lit(0)) < F.col("key"), 1).otherwise(0)
    placed = rows.withColumn("cell", F.shiftright("key", shift)).join(F.broadcast(small), "cell").withColumn("inside", inside)
    return placed.select(*rows.columns, (F.col("before") + F.col("inside")).alias("range"), F.get("edges", F.col("inside")).alias("low"), F.get("edges", F.col("inside") + 1).alias("high"))


def within(value: Column, low: Column, width: Column, parts: Column) -> Column:
    """The part of the span that the value lies in; never less for a greater value."""
    share = (value.cast("double") - low.cast("double")) / width
    return F.least(F.greatest(F.floor(share * parts), F.lit(0)), parts - 1).cast("int")


def shard(docs: DataFrame, shards: int = 40, law: str = "bytes", ranges_per_shard: int = 25, per_range: int = 20, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, shard, slot and its byte offset in the order of the shards."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    rows = written(slim(docs))
    n, total = rows.agg(F.sum("m"), F.sum(F.col("size") * F.col("m"))).first()
    n, total = n or 0, total or 0
    ranges = shards * ranges_per_shard
    hot = [b for k in hot_keys(rows, max(n // ranges, 1)) for b in (k - 1, k) if b >= -(1 << 63)]
    placed = range_of(rows, sorted({*splitters(rows, total, ranges, per_range), *hot}))

    # as many rows as there are ranges
    part_rows = min(part_rows, max(2 * n // ranges, 100))
    large = placed.groupBy("range").agg(F.sum("m").alias("n")).where(F.col("n") > part_rows)
    placed = placed.join(F.broadcast(large.select("range", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))), "range", "left")
    parts, width = F.coalesce("parts", F.lit(1)), F.col("high").cast("double") - F.col("low").cast("double")
    by_key, by_tie = within(F.col("key"), F.col("low"), width, parts), within(F.col("tie"), F.lit(-(2.0**63)), F.lit(WHOLE), parts)
    alone = (F.col("high") == F.col("key")) & (F.col("low") == F.col("key") - 1)
    placed = placed.withColumn("part", F.when(alone, by_tie).otherwise(by_key)).drop("parts", "low", "high")

    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    totals = placed.groupBy("range", "part").agg(F.sum(F.col("size") * F.col("m")).alias("b"), F.sum("m").alias("n"))
    totals = totals.select("range", "part", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("b", "n")))
    order = Window.partitionBy("range", "part").orderBy("key", "tie", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({"b": F.coalesce(F.sum(F.col("size") * F.col("m")).over(order), F.lit(0)), "n": F.coalesce(F.sum("m").over(order), F.lit(0))})
    placed = placed.join(totals, ["range", "part"]).withColumns({"b": F.col("b") + F.col("b_before"), "n": F.col("n") + F.col("n_before")})
    # a row for each copy; very many are dealt out first
    few = placed.where(F.col("m") <= COPIES).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    many = placed.where(F.col("m") > COPIES).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition("key", "block").withColumn("i", F.explode(F.sequence("block", F.least(F.col("block") + COPIES, F.col("m")) - 1))).drop("block")
    each = few.unionByName(many).withColumns({"offset": F.col("b") + F.col("i") * F.col("size"), "rank": F.col("n") + F.col("i")})
    place = (
        F.expr(f"((2 * offset + size) * {shards}) div {2 * max(total, 1)}")
        if law == "bytes"
        else F.expr(f"(rank * {shards}) div {max(n, 1)}")
    )
    each = written(each.select("doc_id", "size", "text_crc32", F.least(place, F.lit(shards - 1)).cast("int").alias("shard"), "rank", "offset"))
    first = each.groupBy("shard").agg(F.min("rank").alias("first"))  # one row per shard
    return each.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), "offset"
    )
