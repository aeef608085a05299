"""Benchmark decontamination with an FM-index per training shard.

The alphabet is the benchmark's vocabulary; every other word is a terminator. A shard is a
bounded number of such words from one Spark partition, kept where enough of them stand in a
row for a window to fit. Its suffixes are sorted (prefix doubling), and their preceding
symbols form a wavelet matrix. All windows are then searched backward at once by rank
queries, their occurrences located from sampled suffix positions, and the spans merged.

A window is ``WINDOW`` consecutive words of an item (the whole item if it has fewer, but not
none). Documents are read once; nothing is shuffled. The benchmark is a stated query set: it
goes to every task, in parts of about ``max_words`` words, with a pass over the documents for
each. ``removed`` cuts the merged spans out of the texts.

Nulls: a null text has no words; null items and items without words are ignored. Repeated
rows are separate documents; repeated items with one id count once. Empty tables give no
hits or no rows. A very long text is part of one shard like any other. Kept columns pass
through unchanged; where they have the names of found ones, a prefix is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import written

WINDOW = 13

#: ASCII bytes that are no word bytes become blanks, A-Z becomes a-z, all others stay.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_SENTINEL = 0


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class WaveletMatrix:
    """Rank and access over a sequence of small integers, by bit planes from the highest."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n, self.planes = len(values), []
        for level in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bits = (values >> level & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            part = np.packbits(bits, bitorder="little")
            packed[: len(part)] = part
            blocks = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)[:-1]])
            zeros = self.n - int(bits.sum())
            self.planes.append((level, blocks, before, zeros))
            values = np.concatenate([values[~bits], values[bits]])

    @staticmethod
    def _ones(blocks: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        low = blocks[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[block] + np.bitwise_count(low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(at)
        for level, blocks, before, zeros in self.planes:
            bit = (symbol >> level & 1).astype(bool)
            a, b = self._ones(blocks, before, start), self._ones(blocks, before, at)
            start, at = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, at - b)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before that place."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for level, blocks, before, zeros in self.planes:
            bit = (blocks[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a, b = self._ones(blocks, before, start), self._ones(blocks, before, at)
            symbol |= bit.astype(np.int64) << level
            start, at = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, at - b)
        return symbol, at - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes; each sentinel is a symbol of its own, by place."""
    n, is_end = len(text), text == _SENTINEL
    ends = int(is_end.sum())
    rank = np.where(is_end, np.cumsum(is_end) - 1, text.astype(np.int64) + ends)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        key = rank[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]]) if step == 1 else fresh  # noqa: F821
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(fresh) - 1
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        # a repeated rank never reaches past the text: sentinels are unique
        tied = np.nonzero(~fresh | np.concatenate([~fresh[1:], [False]]))[0]
        at = order[tied]
        second = np.full(len(at), -1, np.int64)
        inside = at + step < n
        second[inside] = rank[at[inside] + step]
        by = np.lexsort((second, rank[at]))
        at, second = at[by], second[by]
        order[tied] = at
        first = rank[at]
        differs = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        fresh = fresh.copy()
        fresh[tied] = differs
        step *= 2


class FMIndex:
    """Text of symbols 1..sigma-1 in runs that end with the sentinel 0."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_array(text)
        last = text[order - 1]  # before the first word stands the last sentinel
        self.wavelet = WaveletMatrix(last.astype(np.int64), sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        sampled = (order % self.SAMPLE == 0) | (last == _SENTINEL)
        self.sampled, self.n = np.where(sampled, order, -1), len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: symbols, each row filled from the right. The rows [low, high) of each pattern."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.nonzero((back <= lengths) & (low < high))[0]
            if not len(live):
                break
            symbol = patterns[live, -back]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        places, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            known = self.sampled[rows]
            done = known >= 0
            places[todo[done]] = known[done] + steps
            todo, rows = todo[~done], rows[~done]
            symbol, before = self.wavelet.access(rows)
            rows, steps = self.first[symbol] + before, steps + 1
        return places


class Windows:
    """The benchmark's windows as symbols, and the items of each."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.code: dict[bytes, int] = {}
        texts = [[self.code.setdefault(w, len(self.code) + 1) for w in words(text)] for _, text in items]
        sizes = np.array([len(t) for t in texts], np.int64)
        # each item's windows, shorter ones with zeros before them
        count = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        owner = np.repeat(np.arange(len(items)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        flat = np.concatenate([np.zeros(window, np.int32), *(np.concatenate([np.zeros(window, np.int32), np.array(t, np.int32)]) for t in texts)])
        start = window * 2 + np.cumsum(sizes + window) - (sizes + window)
        begin = start[owner] + at + np.minimum(sizes[owner], window) - window
        width = int(np.minimum(sizes, window).max(initial=0))
        rows = np.lib.stride_tricks.sliding_window_view(flat, window)[begin][:, window - width :]
        self.patterns, which = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(axis=1)
        self.shortest = int(self.lengths.min(initial=window)) if len(self.lengths) else 0
        # the items of each window, one after the other
        self.names = [item for item, _ in items]
        pairs = np.unique(np.stack([which.reshape(-1), owner], axis=1), axis=0)
        self.owner, self.owner_start = pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))

    def items(self, pattern: int) -> set:
        return {self.names[i] for i in self.owner[self.owner_start[pattern] : self.owner_start[pattern + 1]].tolist()}


class _Shard:
    def __init__(self, windows: Windows, into: str):
        self.into = into
        self.windows, self.n_words, self.runs, self.owner, self.base, self.size = windows, [], [], [], [], 0
        self.batches: list[pa.RecordBatch] = []

    def add(self, text: str | None) -> None:
        found = words(text)
        doc = len(self.n_words)
        self.n_words.append(len(found))
        codes = np.fromiter(map(self.windows.code.get, found, [0] * len(found)), np.int32, len(found))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], codes > 0, [False]])))
        starts, stops = edges[::2], edges[1::2]
        for a, b in zip(starts.tolist(), stops.tolist()):
            if b - a >= self.windows.shortest:
                self.runs.append(codes[a:b])
                self.owner.append(doc)
                self.base.append(a)
                self.size += b - a + 1

    def hits(self) -> tuple[list[list[tuple[int, int]]], list[set]]:
        """For each document its merged spans of hit words, and the items found."""
        spans: list[list[tuple[int, int]]] = [[] for _ in self.n_words]
        items: list[set] = [set() for _ in self.n_words]
        if not self.runs:
            return spans, items
        w = self.windows
        stops = np.cumsum([len(r) + 1 for r in self.runs])
        text = np.zeros(stops[-1], np.int32)
        starts = np.concatenate([[0], stops[:-1]])
        for at, run in zip(starts.tolist(), self.runs):
            text[at : at + len(run)] = run
        index = FMIndex(text, len(w.code) + 1)
        low, high = index.search(w.patterns, w.lengths)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        places = index.locate(rows)
        run = np.searchsorted(stops, places, "right")
        owner, base = np.array(self.owner)[run], np.array(self.base)[run] + places - starts[run]
        for doc, pattern in set(zip(owner.tolist(), which.tolist())):
            items[doc] |= w.items(pattern)
        for k in np.lexsort((base, owner)).tolist():
            a, b, own = int(base[k]), int(base[k] + w.lengths[which[k]]), spans[owner[k]]
            if own and a <= own[-1][1]:
                own[-1] = (own[-1][0], max(b, own[-1][1]))
            else:
                own.append((a, b))
        return spans, items

    def result(self) -> pa.RecordBatch:
        spans, items = self.hits()
        names = [sorted(map(str, i)) for i in items]
        hit = np.array([sum(b - a for a, b in s) for s in spans], np.int64)
        kept = pa.Table.from_batches(self.batches).combine_chunks()
        found = {
            "n_words": pa.array(self.n_words, pa.int64()),
            "n_hit": pa.array(hit),
            "n_items": pa.array([len(i) for i in items], pa.int64()),
            "items": pa.array(names, pa.list_(pa.string())),
            "spans": pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        }
        own = [pa.concat_arrays(kept[n].chunks) for n in kept.column_names]
        return pa.RecordBatch.from_arrays([*own, pa.StructArray.from_arrays(list(found.values()), list(found))], [*kept.column_names, self.into])


FOUND = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,stop:long>>"


def benchmark_parts(benchmark: DataFrame, max_words: int) -> Iterator[Windows]:
    """The benchmark's windows, in parts of about max_words words."""
    items, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null and item_id is not null").toLocalIterator():
        items.append((row["item_id"], row["text"]))
        size += len(row["text"].split())
        if size >= max_words:
            yield Windows(items)
            items, size = [], 0
    yield Windows(items)


def merged(spans: Column) -> Column:
    """The union of several lists of spans of a document, in order."""
    return F.aggregate(
        F.array_sort(F.flatten(spans)), F.array().cast("array<struct<start:long,stop:long>>"),
        lambda done, s: F.when((F.size(done) > 0) & (s["start"] <= F.get(done, F.size(done) - 1)["stop"]), F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(F.get(done, F.size(done) - 1)["start"].alias("start"), F.greatest(F.get(done, F.size(done) - 1)["stop"], s["stop"]).alias("stop"))),
        )).otherwise(F.concat(done, F.array(s))),
    )


def scan(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), prefix: str = "", shard_words: int = 1 << 20, max_words: int = 1_000_000) -> DataFrame:
    """One row per document: the columns to keep, word counts, items found and merged spans of words to remove.

    The columns found are named with ``prefix``, so that kept ones of the same names do not clash.
    A benchmark of over ``max_words`` words goes to the tasks in parts, one pass over the
    documents for each; their items and spans are united.
    """
    if prefix == "" and set(keep) & {f.name for f in StructType.fromDDL(FOUND)}:
        raise ValueError("a kept column has the name of a found one; give a prefix")
    rows = docs.select(*(F.col(c).alias(f"__kept{i}") for i, c in enumerate(keep)), "text")
    parts, left = [], benchmark_parts(benchmark, max_words)
    windows = next(left)
    while windows:
        parts.append(f"__found{len(parts)}")
        after = next(left, None)
        rows = in_part(rows, windows, parts[-1], shard_words, last=after is None)
        rows, windows = written(rows) if after else rows, after
    first = F.col(parts[0])
    names = {f.name: first[f.name] for f in StructType.fromDDL(FOUND)}
    if len(parts) > 1:
        names["items"] = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(p)["items"] for p in parts)))))
        names["spans"] = merged(F.array(*(F.col(p)["spans"] for p in parts)))
        names["n_items"] = F.size(names["items"]).cast("long")
        names["n_hit"] = F.aggregate(names["spans"], F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return rows.select(*(F.col(f"__kept{i}").alias(c) for i, c in enumerate(keep)), *(c.alias(prefix + n) for n, c in names.items()))


def in_part(rows: DataFrame, windows: Windows, into: str, shard_words: int, last: bool) -> DataFrame:
    """rows (..., text) with a struct of what is found of the windows; less the text if no part is left."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    at = rows.columns.index("text")
    own = [f for f in rows.schema.fields if not (last and f.name == "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(shared.value, into)
        for batch in batches:
            for text in batch.column(at):
                shard.add(text.as_py())
            shard.batches.append(batch.select([f.name for f in own]))
            if shard.size >= shard_words or len(shard.n_words) >= 50_000:
                yield shard.result()
                shard = _Shard(shared.value, into)
        if shard.n_words:
            yield shard.result()

    return rows.mapInArrow(run, StructType([*own, StructField(into, StructType.fromDDL(FOUND))]))


def removed(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs with ``text`` less the words in removal spans (lower-cased A-Z runs as ``words`` cuts them, with what stands between them)."""
    own = [c for c in docs.columns if c != "text"]
    found = scan(docs, benchmark, keep=(*own, "text"), prefix="__", **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(len(own)).to_pylist(), batch.column(len(own) + 1).to_pylist()
            cut = [without(t, s) if s else t for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(cut, pa.string())], [*own, "text"])

    rows = found.select(*own, "text", "__spans")
    return rows.mapInArrow(run, StructType([f for f in rows.schema.fields if f.name != "__spans"])).select(docs.columns)


def without(text: str, spans: list[dict]) -> str:
    place = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : place[span["start"]][0]])
        at = place[span["stop"] - 1][1]
    return "".join([*kept, text[at:]])


def contaminated(prefix: str = "") -> Column:
    """The share rule: a twentieth of the words, and one at least, lies in benchmark windows."""
    n_hit, n_words = F.col(f"{prefix}n_hit"), F.col(f"{prefix}n_words")
    return (n_hit > 0) & (20 * n_hit >= n_words)
