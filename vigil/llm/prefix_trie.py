"""Prefix trie of conversations by union-find over the edges between sorted neighbours.

Every turn becomes a pair of 64-bit hashes of role and text, with the number of its words; the
texts go no further. A conversation c is rebuilt: the first h(c) turns of its base (c - c % 20), then
its own after its first h(c), h being crc32 of the decimal c, mod 4. Equal sequences are
counted first, so a conversation that a third of the table repeats is one row.

1. The distinct sequences are range-sorted. In each partition the edges between neighbours
   carry the length of their longest common prefix (LCP), and are united in descending length. A merge
   of two components makes a branching node above both (or hangs one under the other's
   node, where that lies at the LCP itself). All numbers of a subtree are added up on the way.
2. The branching tree is written out as nodes: those between two branchings have one child and the
   members of the lower one.
3. Only the prefixes of a partition's first and last sequence can go on in its neighbours. They
   are its contracted forest: known by a hash of their prefix, they are added up over the
   partitions, and for each boundary what its common prefix has counted twice is taken
   off again (nodes, children, leaves). Their members' least id is then given to their children.

The rows that cross boundaries are two paths for each partition, whatever it holds.
``ends_sha256`` is one stream of ids for each distinct sequence: ids of one sequence are sorted over
partitions, joined there into blocks, and the blocks hashed in order.

Turns are ordered by ``turn``, null first; ties by their hash. Null role or text is empty; rows without
conv_id belong to no conversation. Repeated rows are turns of their own. A
negative id's base is the next multiple of 20 at or below it. Conversations may become turnless and
are members of the root. An empty table has no nodes. A conversation is one row of 24 bytes a turn,
its longest form here; texts are never gathered. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BASE_OF, KEPT = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
TURN = "struct<a:bigint,b:bigint,w:bigint>"
NOTHING = hashlib.sha256(b"").hexdigest()
SEQUENCES = 50_000


def kept_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % KEPT).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> (conv_id, path): the hashes and words of the rebuilt turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = F.struct(F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), text, role).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))
    # a conversation and its base meet in the same partition
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(BASE_OF))
    each = turns.where("conv_id is not null").select(base.alias("base"), "conv_id", F.struct(F.col("turn"), hashed.alias("h")).alias("t"))
    whole = each.repartition("base").groupBy("base", "conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["h"]).alias("own"))
    first = each.where("conv_id = base").select("base", "t").repartition("base").groupBy("base").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = first.select("base", F.slice(F.transform("own", lambda t: t["h"]), 1, KEPT - 1).alias("given"))
    h = kept_turns(F.col("conv_id"))
    given = F.coalesce(F.slice("given", F.lit(1), h), F.array().cast(f"array<{TURN}>"))
    own = F.slice("own", h + 1, F.size("own") + 1)
    return whole.join(first, "base", "left").select("conv_id", F.concat(given, own).alias("path"))


def common_prefixes(a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """LCP of each sequence with the one before it (of the first: 0)."""
    length = np.diff(offsets)
    lcp = np.zeros(len(length), np.int64)
    if len(length) < 2:
        return lcp
    most = np.minimum(length[1:], length[:-1])
    live = np.arange(1, len(length))
    for depth in range(32):
        live = live[most[live - 1] > depth]
        x, y = offsets[live - 1] + depth, offsets[live] + depth
        live = live[(a[x] == a[y]) & (b[x] == b[y])]
        lcp[live] = depth + 1
    for i in live.tolist():  # long common prefixes one by one
        n = int(most[i - 1])
        x, y = slice(offsets[i - 1], offsets[i - 1] + n), slice(offsets[i], offsets[i] + n)
        differs = np.flatnonzero((a[x] != a[y]) | (b[x] != b[y]))
        lcp[i] = differs[0] if len(differs) else n
    return lcp


class Forest:
    """The branching nodes over sorted distinct sequences; the last one is the root."""

    def __init__(self, offsets: np.ndarray, words: np.ndarray, least: np.ndarray, n: np.ndarray, lcp: np.ndarray):
        length = np.diff(offsets)
        rows = len(length)
        self.total = np.concatenate([[0], np.cumsum(words)])  # words before a place
        self.offsets = offsets
        self.depth, self.low, self.high = length.tolist(), list(range(rows)), list(range(rows))
        self.n, self.least, self.kids = n.tolist(), least.tolist(), [0] * rows
        self.leaves, self.below, self.parent, self.ends = [1] * rows, [0] * rows, [-1] * rows, list(range(rows))
        group, top = list(range(rows)), list(range(rows))

        def find(x: int) -> int:
            while group[x] != x:
                group[x] = group[group[x]]
                x = group[x]
            return x

        for i in (np.argsort(-lcp[1:], kind="stable") + 1).tolist():
            left, right = find(i - 1), find(i)
            x, y, depth = top[left], top[right], int(lcp[i])
            if self.depth[x] == depth:
                self._hang(y, x)
            else:
                if self.depth[y] != depth:
                    y = self._branch(depth, y)
                self._hang(x, y)
                x = y
            group[right] = left
            top[left] = x
        root = top[find(0)]
        if self.depth[root]:
            root = self._branch(0, root)
        self.root = root

    def _branch(self, depth: int, child: int) -> int:
        new = len(self.depth)
        for column, value in ((self.depth, depth), (self.low, self.low[child]), (self.high, self.high[child]), (self.n, 0), (self.least, self.least[child]), (self.kids, 0), (self.leaves, 0), (self.below, 0), (self.parent, -1), (self.ends, -1)):
            column.append(value)
        self._hang(child, new)
        return new

    def _hang(self, child: int, under: int) -> None:
        if self.ends[under] >= 0 and not self.kids[under]:
            self.leaves[under] = 0  # a sequence that others go on from is no leaf
        start = int(self.offsets[self.low[child]])
        words = int(self.total[start + self.depth[child]] - self.total[start + self.depth[under]])
        self.parent[child] = under
        self.kids[under] += 1
        self.n[under] += self.n[child]
        self.least[under] = min(self.least[under], self.least[child])
        self.low[under], self.high[under] = min(self.low[under], self.low[child]), max(self.high[under], self.high[child])
        self.leaves[under] += self.leaves[child]
        self.below[under] += self.below[child] + (self.n[child] - 1) * words


def prefix_ids(a: np.ndarray, b: np.ndarray) -> list[bytes]:
    """A hash of each prefix, the empty one first."""
    pairs, now = np.stack([a, b], axis=1), hashlib.blake2b(digest_size=16)
    found = [now.digest()]
    for turn in pairs:
        now.update(turn.tobytes())
        found.append(now.digest())
    return found


PATH = "array<bigint>"
NODES = (
    f"part int, kind string, id binary, parent_id binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    f" saved long, end_conv long, end_n long, first_a {PATH}, first_b {PATH}, first_w {PATH}, last_a {PATH}, last_b {PATH}, last_w {PATH}"
)
OWN = [f.split()[0] for f in NODES.split(", ")]


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition (part, conv_id, n, path) -> its nodes: 'closed' ones, 'open' ones that may go on in neighbours, and one row 'edge' with its first and last path."""
    whole = [x for x in batches if x.num_rows]
    if not whole:
        return
    table = pa.Table.from_batches(whole).combine_chunks()
    part, conv, n = table.column(0)[0].as_py(), table.column(1).to_numpy(), table.column(2).to_numpy()
    path = pa.concat_arrays(table.column(3).chunks)
    turn = path.flatten()
    a, b, w = (turn.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    offsets = np.concatenate([[0], np.cumsum(path.value_lengths().to_numpy())])
    f = Forest(offsets, w, conv, n, common_prefixes(a, b, offsets))
    rows = len(conv)
    firsts = prefix_ids(a[: offsets[1]], b[: offsets[1]])
    lasts = prefix_ids(a[offsets[-2] :], b[offsets[-2] :])
    depth, parent, low, high = (np.array(x) for x in (f.depth, f.parent, f.low, f.high))
    above = np.where(parent >= 0, depth[parent], -1)
    # each node of the trie: the branching node whose members it has, and its depth
    length = depth - above
    node = np.repeat(np.arange(len(depth)), length)
    d = np.arange(len(node)) - np.repeat(np.cumsum(length) - length, length) + above[node] + 1
    many, least = np.array(f.n)[node], np.array(f.least)
    bottom = d == depth[node]
    start = offsets[low[node]]
    saved = np.array(f.below)[node] + (many - 1) * (f.total[start + depth[node]] - f.total[start + np.maximum(d - 1, 0)])
    up = np.where(d > above[node] + 1, node, parent[node])  # the branching node of the parent
    of_parent = np.where(d > 0, least[up], 0)
    on_first, on_last = low[node] == 0, high[node] == rows - 1
    ends = np.array(f.ends)[node]
    has_end = bottom & (ends >= 0)
    is_open = on_first | on_last
    up_open = (d > 0) & ((low[up] == 0) | (high[up] == rows - 1))

    def ids(which: np.ndarray, at: np.ndarray, of: np.ndarray) -> list[bytes | None]:
        return [(firsts if low[k] == 0 else lasts)[x] if y else None for k, x, y in zip(of.tolist(), at.tolist(), which.tolist())]

    order = np.argsort(is_open, kind="stable")
    for piece in np.array_split(order, max(1, len(order) // 20_000)):
        k = piece
        out = {
            "part": pa.array(np.full(len(k), part, np.int32)), "kind": pa.array(np.where(is_open[k], "open", "closed").tolist()),
            "id": pa.array(ids(is_open[k], d[k], node[k]), pa.binary()), "parent_id": pa.array(ids(up_open[k], d[k] - 1, up[k]), pa.binary()),
            "depth": pa.array(d[k]), "conv_id": pa.array(least[node[k]]), "parent_conv_id": pa.array(of_parent[k], mask=d[k] == 0), "n_convs": pa.array(many[k]),
            "n_children": pa.array(np.where(bottom[k], np.array(f.kids)[node[k]], 1)), "n_leaves": pa.array(np.array(f.leaves)[node[k]]), "saved": pa.array(saved[k]),
            "end_conv": pa.array(conv[np.maximum(ends[k], 0)], mask=~has_end[k]), "end_n": pa.array(n[np.maximum(ends[k], 0)], mask=~has_end[k]),
        }
        empty = pa.nulls(len(k), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.values(), *[empty] * 6], OWN)
    ends_of = [x[s] for s in (slice(offsets[0], offsets[1]), slice(offsets[-2], offsets[-1])) for x in (a, b, w)]
    blank = [pa.array([part], pa.int32()), pa.array(["edge"]), *[pa.nulls(1, pa.binary())] * 2, *[pa.nulls(1, pa.int64())] * 9]
    yield pa.RecordBatch.from_arrays([*blank, *(pa.array([x], pa.list_(pa.int64())) for x in ends_of)], OWN)


COUNTS = ["n_convs", "n_children", "n_leaves", "saved"]


def _boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last path of one partition and the first of the next (six arrays) -> what their common prefix has counted twice, for each of its nodes."""
    for batch in batches:
        for k in range(batch.num_rows):
            a, b, w, c, d, _ = (column[k].values.to_numpy() for column in batch.columns)
            n = min(len(a), len(c))
            differs = np.flatnonzero((a[:n] != c[:n]) | (b[:n] != d[:n]))
            n = int(differs[0]) if len(differs) else n
            words = np.concatenate([[0], w[:n]])  # of the root and of each node below it
            again = np.cumsum(words[::-1])[::-1]
            out = {
                "id": pa.array(prefix_ids(a[:n], b[:n]), pa.binary()),
                "n_convs": pa.array(np.zeros(n + 1, np.int64)),
                "n_children": pa.array(-(np.arange(n + 1) < n).astype(np.int64)),
                # the last sequence ends where the next goes on
                "n_leaves": pa.array(np.full(n + 1, -int(n == len(a)), np.int64)),
                "saved": pa.array(again),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (rep, conv_id) -> (rep, first, ids): blocks of comma-joined ids."""
    for batch in batches:
        rep, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        borders = np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1], [True]]))
        out = [(int(rep[x]), int(conv[x]), ",".join(map(str, conv[x:y].tolist()))) for x, y in zip(borders[:-1].tolist(), borders[1:].tolist()) if y > x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["rep", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by (rep, first) -> (rep, sha), a block at a time."""
    now = state = None
    for batch in batches:
        out = []
        for rep, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            if rep != now:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = rep, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["rep", "sha"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["rep", "sha"])


def trie(turns: DataFrame, sequences: int = SEQUENCES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``sequences`` is the number of distinct sequences that a partition of the sort holds at most, about.
    """
    paths = rebuilt(turns).withColumns({"s": F.xxhash64("path"), "t": F.xxhash64(F.lit(3), F.col("path"))})
    paths = written(paths)
    groups = written(paths.groupBy("s", "t").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")))
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // sequences))
    one = paths.select("conv_id", "path").join(groups.select(F.col("rep").alias("conv_id"), "n"), "conv_id")
    one = one.repartitionByRange(parts, "path").sortWithinPartitions("path").select(F.spark_partition_id().alias("part"), "conv_id", "n", "path")
    nodes = written(one.mapInArrow(_partition, NODES))

    edges = nodes.where("kind = 'edge'").select("part", *OWN[-6:])
    ordered = Window.orderBy("part")  # one row for each partition
    paired = edges.select(*(F.lag(f"last_{x}").over(ordered).alias(f"last_{x}") for x in "abw"), *(f"first_{x}" for x in "abw")).where("last_a is not null")
    twice = paired.mapInArrow(_boundary, "id binary, n_convs long, n_children long, n_leaves long, saved long")
    open_ = nodes.where("kind = 'open'")
    nothing = {c: F.lit(None) for c in ("parent_id", "depth", "conv_id", "end_conv", "end_n")}
    columns = ["id", "parent_id", "depth", "conv_id", "end_conv", "end_n", *COUNTS]
    added = open_.select(columns).unionByName(twice.withColumns(nothing).select(columns)).groupBy("id").agg(
        *(F.max(c).alias(c) for c in ("parent_id", "depth", "end_conv", "end_n")), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in COUNTS)
    )
    added = written(added)
    known = added.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("least"))
    whole = added.join(known, "parent_id", "left").withColumnRenamed("least", "parent_conv_id")
    # children of open nodes ask their own partition's copy of the parent, so the root's are not one group
    local = open_.select("part", F.col("id").alias("parent_id")).join(known, "parent_id")
    under = nodes.where("kind = 'closed' and parent_id is not null").drop("parent_conv_id").join(written(local), ["part", "parent_id"]).withColumnRenamed("least", "parent_conv_id")
    inner = nodes.where("kind = 'closed' and parent_id is null")
    own = ["conv_id", "depth", "parent_conv_id", *COUNTS, "end_conv", "end_n"]
    every = inner.select(own).unionByName(under.select(own)).unionByName(whole.select(own))

    repeated = written(groups.where("n > 1"))
    members = paths.select("conv_id", "s", "t").join(repeated, ["s", "t"]).select("rep", "conv_id")
    ids = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_joined, "rep long, first long, ids string")
    shas = ids.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(_hashed, "rep long, sha string")
    alone = F.coalesce(F.col("end_n"), F.lit(0)) < 2
    single = F.when(F.col("end_n") == 1, F.sha2(F.col("end_conv").cast("string"), 256)).otherwise(F.lit(NOTHING))
    done = every.where(alone).withColumn("ends_sha256", single)
    shared = every.where(~alone).join(shas.select(F.col("rep").alias("end_conv"), F.col("sha").alias("ends_sha256")), "end_conv")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"]
    return done.select(result).unionByName(shared.select(result))
