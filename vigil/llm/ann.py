"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every table hashes a vector, scaled to length one, by ``hashes`` Gaussian projections cut into
cells of ``width``. A query visits its own bucket and then perturbed ones in the order of
their estimated success: the sum of the squared distances from its projections to the cell
borders crossed. The candidates of all tables are merged and ranked by the exact cosine.

Equal vectors are one point of the index (with their least ids), so a vector that a third of
the rows share costs no more than another. Large buckets are cut into blocks, and a bucket's
queries meet each block as one matrix product in which all members take part: there is no
cap. Queries that find fewer neighbours than asked are compared with all rows, in blocks.

On directions that are nearly uniform (the nearest of many vectors at cosines of 0.4), any
hashing must look at a good part of the rows for a recall of 0.9; the defaults do. Where
neighbours are closer, fewer ``probes`` do.

Vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part, neither do null ids. Components may be as small or large as doubles are.
Rows that repeat an id count once for each distinct vector. Ties go to the smaller id. An empty
table gives an empty result. Very long vectors are rows like others; a block of BLOCK of them is
one matrix. Columns other than the two that are named are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

TABLES, HASHES, WIDTH, PROBES = 8, 8, 2.5, 30
BLOCK = 4096


class Hashes:
    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int = 11):
        g = np.random.default_rng(seed)
        a = g.normal(size=(tables, dim, hashes))
        if hashes <= dim:  # orthogonal directions spread better
            a = np.linalg.qr(a)[0] * np.sqrt(dim)
        self.a, self.b, self.width = a, g.uniform(0, width, (tables, 1, hashes)), width
        self.mix = g.integers(1, 1 << 62, hashes, dtype=np.int64) | 1

    def places(self, unit: np.ndarray) -> np.ndarray:
        """(tables, vectors, hashes), in cells."""
        return (unit @ self.a + self.b) / self.width

    def codes(self, cells: np.ndarray) -> np.ndarray:
        return (cells.astype(np.int64) * self.mix).sum(axis=-1)

    def probes(self, place: np.ndarray, count: int) -> np.ndarray:
        """Codes of the buckets that one query visits in one table, likeliest first."""
        cell = np.floor(place)
        inside = place - cell
        steps = sorted([(f * f, j, -1) for j, f in enumerate(inside)] + [((1 - f) ** 2, j, 1) for j, f in enumerate(inside)])
        chosen, heap = [()], [(steps[0][0], (0,))]
        while heap and len(chosen) < count:
            cost, at = heapq.heappop(heap)
            if len({steps[x][1] for x in at}) == len(at):
                chosen.append(at)
            last = at[-1]
            if last + 1 < len(steps):
                heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*at[:-1], last + 1)))
                heapq.heappush(heap, (cost + steps[last + 1][0], (*at, last + 1)))
        cells = np.repeat(cell[None, :], len(chosen), axis=0)
        for row, at in enumerate(chosen):
            for x in at:
                cells[row, steps[x][1]] += steps[x][2]
        return self.codes(cells)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors, each scaled by a power of two to components of about 1: cosines stay the same to the last bit, and no square is too small or too large."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _points(dim: int, keep: int):
    """Rows (id, vector) -> valid distinct vectors of the batch with their least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, list[int]] = defaultdict(list)
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or v is None or len(v) != dim or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    ids[(x + 0.0).tobytes()].append(i)  # -0.0 is 0.0
            least = [sorted(set(k))[:keep] for k in ids.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(least, pa.list_(pa.int64()))], ["vec", "ids"])

    return run


def _entries(hashes: Hashes, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), dim)
            codes = hashes.codes(np.floor(hashes.places(x / np.linalg.norm(x, axis=1, keepdims=True))))
            for t in range(len(codes)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(codes[t]), *batch.columns], ["tab", "bucket", "rep", "vec"]
                )

    return run


def _visits(hashes: Hashes, dim: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = matrix(part.column(1), dim)
                places = hashes.places(x / np.linalg.norm(x, axis=1, keepdims=True))
                for t in range(len(places)):
                    codes = [hashes.probes(p, probes) for p in places[t]]
                    row = np.repeat(np.arange(len(x)), [len(c) for c in codes])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), t, np.int32)), pa.array(np.concatenate(codes)), *(c.take(pa.array(row)) for c in part.columns)],
                        ["tab", "bucket", "rep", "vec"],
                    )

    return run


def nearest(q: np.ndarray, x: np.ndarray, reps: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, rep and exact cosine of each query's nearest points."""
    nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    near = (q @ x.T) / nq[:, None] / nx
    if len(x) > keep:
        floor = -np.partition(-near, keep - 1, axis=1)[:, keep - 1 : keep]
        row, col = np.nonzero(near >= floor - 1e-12)
    else:
        row, col = np.nonzero(np.ones_like(near, bool))
    score = np.einsum("ij,ij->i", q[row], x[col]) / (nq[row] * nx[col])
    order = np.lexsort((reps[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < keep], reps[col[nth < keep]], score[nth < keep]


def _compare(dim: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                q, x = batch.column("queries")[k].values, batch.column("members")[k].values
                qr, xr = q.field("rep").to_numpy(), x.field("rep").to_numpy()
                row, rep, score = nearest(matrix(q.field("vec"), dim), matrix(x.field("vec"), dim), xr, keep)
                out.append((qr[row], rep, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query", "rep", "score"])

    return run


SCORED = "query long, rep long, score double"


def search(
    rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES,
) -> DataFrame:
    """The k nearest others of each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    keep = k + 1
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    common = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = max(1, common["d"] if common else 1)
    points = rows.mapInArrow(_points(dim, keep), "vec binary, ids array<long>")
    points = points.groupBy("vec").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    points = checkpoint(points.select(F.xxhash64("vec").alias("h"), "vec", "ids", F.col("ids")[0].alias("rep")))
    asked = rows.where(F.col("id") % every == 0).mapInArrow(_points(dim, 1 << 30), "vec binary, ids array<long>")
    asked = asked.select("vec", F.explode("ids").alias("query_id"))
    asked = checkpoint(asked.join(points.select("vec", "rep"), "vec").select("query_id", "rep").distinct())
    if asked.isEmpty():
        return points.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = points.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vec")

    index = Hashes(dim, tables, hashes, width)
    entries = points.select("rep", "vec").mapInArrow(_entries(index, dim), "tab int, bucket long, rep long, vec binary")
    visits = queries.mapInArrow(_visits(index, dim, probes), "tab int, bucket long, rep long, vec binary")
    scored = checkpoint(meet(blocks(entries, "members", ["tab", "bucket"]), blocks(visits, "queries", ["tab", "bucket"]), dim, keep))

    def best(found: DataFrame) -> DataFrame:
        nth = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
        found = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
        found = found.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= keep)
        return found.join(points.select("rep", F.col("ids")), "rep")

    found = checkpoint(best(scored))
    have = found.groupBy("query").agg(F.sum(F.size("ids")).alias("n"))
    short = checkpoint(queries.join(have.where(F.col("n") >= keep), queries["rep"] == have["query"], "left_anti"))
    if not short.isEmpty():
        # the points are dealt into parts, and the queries that are short meet each of them
        parts = points.count() // BLOCK + 1
        part = F.pmod(F.xxhash64("rep"), F.lit(parts)).alias("bucket")
        every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("bucket")
        members = points.select(F.lit(0).alias("tab"), part, "rep", "vec")
        asking = short.select(F.lit(0).alias("tab"), every_part, "rep", "vec")
        all_rows = meet(blocks(members, "members", ["tab", "bucket"]), blocks(asking, "queries", ["tab", "bucket"]), dim, keep)
        found = found.join(short, found["query"] == short["rep"], "left_anti").unionByName(checkpoint(best(all_rows)))
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.withColumnRenamed("rep", "query").join(found.select("query", "score", "ids"), "query")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(nth))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def blocks(entries: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Entries (rep, vec) of each key in blocks of about BLOCK, whatever their number."""
    entries = checkpoint(entries)
    large = checkpoint(entries.groupBy(*key).count().where(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).alias("parts")))
    part = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))
    return entries.join(large, key, "left").groupBy(*key, part.alias("part")).agg(F.collect_list(F.struct("rep", "vec")).alias(name))


def meet(members: DataFrame, queries: DataFrame, dim: int, keep: int) -> DataFrame:
    key = ["tab", "bucket"]
    joined = members.drop("part").join(queries.drop("part"), key)
    return joined.select("queries", "members").mapInArrow(_compare(dim, keep), SCORED)
