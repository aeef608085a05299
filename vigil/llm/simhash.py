"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint is the bitwise majority of the XXH64 values (seed 42) of its
3-word shingles. Distinct fingerprints are dealt into tiles by the population counts of
their four 16-bit quarters. Two fingerprints that differ in at most ``radius`` bits have
quarter counts that differ by at most ``radius`` in sum, so only tile pairs within that
distance are compared; within a pair numpy compares everything with everything by
exclusive-or and bit counts. Nothing is approximate and no candidate is capped: large
tiles are cut into blocks and every block pair is compared.

Copies share a fingerprint and are compared once, whatever their number. Each block pair
reports a spanning star of its links, not all of them; the components are the same.

Nulls: a null text is an empty one (fingerprint zero, linked like any other). Rows that
repeat a doc_id each get a result row. Components are named by their least doc_id (null
only if no member has one). An empty table gives an empty result. Other columns are ignored by
``near_duplicates`` and pass through ``one_of_each``. A very long text is one row, read whole; its
shingles are counted bit by bit, and only its fingerprint goes further.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .graph import connected_components

SHINGLE = 3
SEED = 42
BLOCK = 2048


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()  # on bytes: A-Z only, and exactly the white space of ASCII
    if not words:
        return 0
    if len(words) < SHINGLE:
        digests = xxhash.xxh64_digest(b" ".join(words), SEED)
    else:
        digest, join = xxhash.xxh64_digest, b" ".join
        digests = b"".join([digest(join(s), SEED) for s in zip(words, words[1:], words[2:])])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(bits)
    return int(np.packbits(majority).view(">u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted fingerprint arrays -> their bytes."""
    for batch in batches:
        packed = [np.array(v, np.int64).tobytes() for v in batch.column("fps").to_pylist()]
        columns = [batch.column(c) for c in ("tile", "block")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], ["tile", "block", "fps"])


def star_of_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of the links between the two blocks."""
    left, right = [], []
    for at in range(0, len(a), 512):
        near = np.bitwise_count(a[at : at + 512, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right) + (0 if same else len(a))
    values = (a if same else np.concatenate([a, b])).view(np.int64)
    label = np.arange(len(values))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(len(values)))[0]
    return values[moved], values[label[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for same, a, b in zip(*(batch.column(c).to_pylist() for c in ("same", "left", "right"))):
                u, v = star_of_links(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), same, radius)
                us.append(u)
                vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def tile_links(distinct: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """distinct (fp) -> links (u, v) that connect what is within the radius."""
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    code = lambda c: sum((x * 32**k for k, x in enumerate(c)), F.lit(0))
    tiled = distinct.withColumn("tile", code(quarters).cast("int"))
    # at most 17**4 tiles, whatever the data
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    sizes = checkpoint(sizes)
    blocks = (
        tiled.join(F.broadcast(sizes), "tile")
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int"))
        .groupBy("tile", "block")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .mapInArrow(_blocks, "tile int, block int, fps binary")
    )
    blocks = checkpoint(blocks)
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    ahead = sorted({sum(x * 32**k for k, x in enumerate(d)) for d in steps if d >= (0, 0, 0, 0)})
    other = F.broadcast(sizes.select(F.col("tile").alias("other"), F.col("n_blocks").alias("n_other")))
    step = F.explode(F.array([F.lit(x) for x in ahead]))
    pair = ["first", "second", "a", "b"]
    left = (
        blocks.withColumn("step", step)
        .withColumn("other", F.col("tile") + F.col("step"))
        .join(other, "other")
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)))
        .where((F.col("step") != 0) | (F.col("b") >= F.col("block")))
        .select(F.col("tile").alias("first"), F.col("other").alias("second"), F.col("block").alias("a"), "b", F.col("fps").alias("left"))
    )
    right = (
        blocks.withColumn("step", step)
        .withColumn("other", F.col("tile") - F.col("step"))
        .join(other, "other")
        .withColumn("a", F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)))
        .where((F.col("step") != 0) | (F.col("a") <= F.col("block")))
        .select(F.col("other").alias("first"), F.col("tile").alias("second"), "a", F.col("block").alias("b"), F.col("fps").alias("right"))
    )
    same = (F.col("first") == F.col("second")) & (F.col("a") == F.col("b"))
    return left.join(right, pair).select(same.alias("same"), "left", "right").mapInArrow(_compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, text_hash, fingerprint (16 hex digits), component_id, class_size, first.

    ``first`` marks the one of its class with the least doc_id (then text_hash).
    """
    rows = checkpoint(fingerprints(docs))
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    distinct = checkpoint(rows.groupBy("fp").agg(F.min(own).alias("least"), F.count("*").alias("n")))
    roots = connected_components(tile_links(distinct.select("fp"), radius))
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = checkpoint(named)
    classes = checkpoint(named.groupBy("root").agg(F.min("least").alias("least"), F.sum("n").alias("class_size")))
    of_fp = checkpoint(named.select("fp", "root").join(classes, "root").select("fp", "least", "class_size"))
    return rows.join(of_fp, "fp").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"), "class_size", (own == F.col("least")).alias("first"),
    )


def one_of_each(docs: DataFrame, radius: int = 2) -> DataFrame:
    """docs less all but one document of each class of near duplicates."""
    first = checkpoint(near_duplicates(docs, radius).where("first").groupBy("doc_id", "text_hash").count())
    hashed = docs.withColumn("__text_hash", F.xxhash64("text"))
    same = lambda d, e: d["doc_id"].eqNullSafe(e["doc_id"]) & (d["__text_hash"] == e["text_hash"])
    kept = hashed.join(first, same(hashed, first), "left_semi")
    repeated = first.where("count > 1")
    if not repeated.isEmpty():  # rows that repeat doc_id and text
        once = kept.join(repeated, same(kept, repeated), "left_semi").dropDuplicates(["doc_id", "__text_hash"])
        kept = kept.join(repeated, same(kept, repeated), "left_anti").unionByName(once)
    return kept.drop("__text_hash")
