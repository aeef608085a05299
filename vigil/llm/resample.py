"""Importance resampling of documents towards the benchmark's distribution of word features.

Features are the runs of one to three consecutive words (lower-cased A-Z, joined by one blank),
with repeats; each falls into the bucket crc32 mod ``BUCKETS``. A bucket's gain is the floor of
1000 times the logarithm of its smoothed share in the target against that in the documents, a
document's weight the sum over its features. Noise from a hash of the id turns the draw of
the heaviest into a sample without replacement (Gumbel top-k).

The checksums come from a table of places: CRC-32 is the exclusive or of what each byte adds
at its distance from the end, and of a constant for the length. The runs that end at one word
share these distances, so the bytes of the longest are looked up once and its three parts are
folded by ``bitwise_xor.reduceat``. Runs of over ``PLACES`` bytes are folded block by block,
the checksum so far being moved on by a block of zeros before the next.

Texts are read twice, once for the counts of the buckets and once for the weights, and never
shuffled; a task hands on at most ``BUCKETS`` counts. The gains, ``BUCKETS`` numbers, go to all
tasks. The draw is a range sort of the scores with the totals of its partitions; no row of the
draw passes through the driver.

Nulls: a null text has no words (no features, weight 0), as have empty ones; a null doc_id is
hashed as an empty one and comes last among equal scores. Documents of under ``min_words``
words are returned and never drawn. Repeated rows are documents of their own. An empty table gives an
empty result, and an empty target leaves the smoothed shares of no features. A very long text
or word is folded in blocks. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import written
from .decontam import WORD_BYTES
from .wordspans import blocks, ragged, spans

BUCKETS, WORDS, PLACES, BLANK = 10_000, 3, 256, 0x20
LOWER = np.frombuffer(WORD_BYTES, np.uint8)

#: What a byte adds to the checksum at each distance from the end: PLACED[distance << 8 | byte].
PLACED = np.array(
    [zlib.crc32(bytes([byte]) + bytes(far)) ^ zlib.crc32(bytes(far + 1)) for far in range(PLACES) for byte in range(256)], np.uint32
)
#: The checksum of as many zeros.
OF_LENGTH = np.array([zlib.crc32(bytes(n)) for n in range(PLACES + 1)], np.uint32)


def _moved_on() -> np.ndarray:
    """[k, value]: byte k of a checksum, as it is PLACES zeros later."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    step = PLACED[:256]  # the last byte's own part
    for _ in range(PLACES):
        now = (now >> np.uint32(8)) ^ step[now & np.uint32(0xFF)]
    return now


MOVED = _moved_on()


def long_crc(span: np.ndarray) -> int:
    """The checksum of a run of any length, block by block from its start."""
    head = len(span) % PLACES
    padded = np.concatenate([np.zeros(PLACES - head, np.uint8), span]) if head else span  # leading zeros add nothing
    far = np.arange(PLACES - 1, -1, -1) << 8
    now = 0
    for at in range(0, len(padded), PLACES * 1024):
        part = padded[at : at + PLACES * 1024].reshape(-1, PLACES)
        each = np.bitwise_xor.reduceat(PLACED[far | part].ravel(), np.arange(0, part.size, PLACES))
        for block in each.tolist():
            now = int(MOVED[0, now & 255] ^ MOVED[1, now >> 8 & 255] ^ MOVED[2, now >> 16 & 255] ^ MOVED[3, now >> 24]) ^ block
    return now ^ zlib.crc32(bytes(len(span)))


def features(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the runs that end at each word, (words, WORDS) with -1 where a text has begun too late, and the words before each border."""
    low = LOWER[raw]
    starts, stops, before = spans(low != BLANK, borders)
    n = len(starts)
    found = np.full((n, WORDS), -1, np.int64)
    if not n:
        return found, before
    # the words with one blank behind each
    length = stops - starts
    at, _, begin = ragged(starts, length + 1)
    joined = low[np.minimum(at, len(low) - 1)]
    end = begin + length
    joined[end] = BLANK
    nth = np.arange(n) - np.repeat(before[:-1], np.diff(before))
    back = np.minimum(nth, WORDS - 1)
    size = end - begin[np.arange(n) - back]
    fits = size <= PLACES
    last = (end - 1).astype(np.int32)
    for part in np.array_split(np.flatnonzero(fits), max(1, int(size[fits].sum()) >> 16)):  # what a cache holds
        if not len(part):
            continue
        first = begin[part - back[part]]
        base = np.cumsum(size[part]) - size[part]
        at = np.arange(int(size[part].sum()), dtype=np.int32) + np.repeat((first - base).astype(np.int32), size[part])
        added = PLACED[(np.repeat(last[part], size[part]) - at) << 8 | joined[at]]
        # the parts of the longest run: from each of its words up to the next
        words, word_at, from_ = ragged(part - back[part], back[part] + 1)
        each = np.bitwise_xor.reduceat(added, np.repeat(base - first, back[part] + 1) + begin[words])
        own = from_ + back[part]
        crc = np.zeros(len(part), np.uint32)
        for k in range(WORDS):
            has = back[part] >= k
            crc[has] ^= each[own[has] - k]
            word = part[has]
            found[word, k] = (crc[has] ^ OF_LENGTH[end[word] - begin[word - k]]) % BUCKETS
    for word in np.flatnonzero(~fits).tolist():
        for k in range(int(back[word]) + 1):
            found[word, k] = long_crc(joined[begin[word - k] : end[word]]) % BUCKETS
    return found, before


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (bucket, n), one row for each bucket that the task has met."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, raw, borders in blocks(batch, 0):
            found, _ = features(raw, borders)
            total += np.bincount(found[found >= 0], minlength=BUCKETS)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """Features in each bucket: (bucket, n), at most BUCKETS rows."""
    return texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's gain; the counts gathered are BUCKETS rows, whatever the data."""
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for texts, into in ((docs, s), (target, t)):
        for row in bucket_counts(texts).collect():
            into[row["bucket"]] = row["n"]
    of_s, of_t = int(s.sum()), int(t.sum())
    ratio = lambda x, y: float(y + 1) * float(of_s + BUCKETS) / (float(x + 1) * float(of_t + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(x, y))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(np.append(gain, 0))  # the last for no bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        for batch in batches:
            for part, raw, borders in blocks(batch, 1):
                found, before = features(raw, borders)
                so_far = np.concatenate([[0], np.cumsum(value[found].sum(axis=1))])
                n = np.diff(before)
                many = sum(np.maximum(n - k, 0) for k in range(WORDS))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (n, many, so_far[before[1:]] - so_far[before[:-1]]))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = 42):
    """1000 times a Gumbel number told by the id, as a whole number."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition with their number in it."""
    done = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(done, done + batch.num_rows))], [*batch.schema.names, "nth"])
        done += batch.num_rows


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and, if it is drawn, rank."""
    scored = written(weigh(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise(seed)))
    able = F.col("n_words") >= min_words
    drawn = percent * scored.where(able).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = scored.where(able).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    rows = written(rows.mapInArrow(numbered, StructType([*rows.schema.fields, StructField("nth", LongType())])))
    # one row for each partition of the sort
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("nth") + 1
    ranked = rows.join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= drawn, rank))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    own = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(own).unionByName(rest.select(own))
