"""Removal of passages that an earlier document holds, by suffix automata of reference shards.

A window is ``window`` consecutive words of a document. A word goes if a window over it also
starts in a document with a smaller doc_id; all windows are those of the input. Words are
symbols of 64 bits, hashed from their bytes in numpy.

1. Of equal texts all but those with the least doc_id go whole (if they hold a window).
2. The others are sieved. Of every half window of runs of ``window // 2`` words the run with
   the least hash is marked, so that equal windows hold equal marks. Around marks that two
   documents share, all windows are hashed and counted: those of one document only are left.
   For the others the least doc_id is told, the window's home.
3. Homes are the references: their windows' runs of words are dealt into shards by doc_id, so
   each distinct repeated window is in exactly one shard, whatever the number of copies. Shards
   hold about ``shard_words`` words, or one document that holds more.
4. For each shard a suffix automaton is built, with the least doc_id of every state. The runs of
   windows that have their home in it stream through it for matching statistics: the longest
   suffix at each word that the references hold. Where it reaches ``window`` words and the
   state of that length belongs to a smaller doc_id, the span goes. Spans are merged to maximal ones.

An automaton goes to the runs that ask for it, not to every task: with all automata in all
tasks the work would be documents times shards. A shard's words (not its states) travel, once
for each ``block_words`` words that ask for it, so a passage that a third of the documents share is
streamed by as many tasks as it needs. Only documents with a shared mark are shuffled with their
text. No group is gathered but the marks, runs and spans of one document.

Nulls: a null text has no words and is returned as empty; a null doc_id comes last in order.
Rows with equal doc_id are not earlier than one another, so neither removes from the other. Repeated rows get
equal results. Texts of fewer words than a window stay whole. Empty tables give empty results. A
very long text is one row: 8 bytes a word while it is sieved. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .line_dedup import slot, slots
from .wordspans import BLOCK_BYTES, blocks, spans

WINDOW, SHARD_WORDS, BLOCK_WORDS = 50, 20_000, 200_000
LAST = (1 << 63) - 1

#: Blanks are 0x20 and 0x09-0x0D, as bytes of UTF-8.
IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SYMBOL = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse, as many as asked for."""

    def __init__(self, factor: int):
        self.factors = factor, pow(factor, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            many = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(many - 1, f, np.uint64))) for f in self.factors)
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS = Powers(FACTOR), Powers(FACTOR ^ 0x5851F42D4C957F2C)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def range_hashes(values: np.ndarray, powers: Powers, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of values[start:stop] for each range, the same wherever the values stand."""
    up, down = powers.get(len(values) + 1)
    so_far = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1])])
    return mixed((so_far[stops] - so_far[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def word_codes(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the words before each border. Long texts are cut at blanks, so memory is that of a block."""
    if len(raw) <= 2 * BLOCK_BYTES:
        starts, stops, before = spans(IN_WORD[raw], borders)
        return range_hashes(SYMBOL[raw], BYTE_POWERS, starts, stops), before
    found, n, at = [], 0, 0
    while at < len(raw):
        end = min(at + BLOCK_BYTES, len(raw))
        while end < len(raw) and IN_WORD[raw[end - 1]]:  # up to the next blank
            blank = np.flatnonzero(~IN_WORD[raw[end : end + BLOCK_BYTES]])
            end = min(end + (int(blank[0]) + 1 if len(blank) else BLOCK_BYTES), len(raw))
        codes, _ = word_codes_of(raw[at:end])
        found.append(codes)
        n, at = n + len(codes), end
    return np.concatenate(found), np.array([0, n])


def word_codes_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, stops, before = spans(IN_WORD[raw], np.array([0, len(raw)]))
    return range_hashes(SYMBOL[raw], BYTE_POWERS, starts, stops), before


def marks(codes: np.ndarray, before: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the marked runs, and their hashes: of each window the run with the least hash, the leftmost of equals."""
    half = window // 2
    choices = window - half + 1
    if len(codes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(codes) - half + 1)
    run = range_hashes(codes, WORD_POWERS, at, at + half)
    best = np.argmin(np.lib.stride_tricks.sliding_window_view(run, choices), axis=1) + np.arange(len(run) - choices + 1)
    end = np.repeat(before[1:], np.diff(before))[: len(best)]
    place = np.unique(best[np.arange(len(best)) + window <= end])
    return place, run[place]


def words_of(text: str) -> list[str]:
    return text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")


def kept_words(text: str | None, runs: list[tuple[int, int]] = ()) -> tuple[int, int, str]:
    """Words, words cut, and the SHA-256 of those kept, joined by one blank."""
    found = [w for w in words_of(text or "") if w]
    kept, at, cut = [], 0, 0
    for low, high in runs:
        kept += found[at:low]
        at, cut = high, cut + high - low
    kept += found[at:]
    return len(found), cut, hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()


def _read(window: int):
    """(doc_id, ord, key, same, text) -> the row as it is if nothing goes, with its marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, borders in blocks(batch, 4):
                codes, before = word_codes(raw, borders)
                place, mark = marks(codes, before, window)
                cut = np.searchsorted(place, before)
                doc = np.searchsorted(before[1:], place, "right")
                whole = [kept_words(t)[2] for t in part.column(4).to_pylist()]
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v)) for v in (mark.view(np.int64), place - before[doc])]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(np.diff(before)), pa.array(whole, pa.string()), *lists], ["doc_id", "ord", "key", "same", "n_words", "sha", "marks", "places"])

    return run


def _segments(window: int):
    """(key, ord, text, places) -> (key, ord, at, codes): the words that a window over a mark can reach, runs that meet as one."""
    half = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, raw, borders in blocks(batch, 2):
                codes, before = word_codes(raw, borders)
                for k, (key, ord_, places) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist())):
                    own = codes[before[k] : before[k + 1]].view(np.int64)
                    place = np.unique(np.array(places, np.int64))
                    low, high = np.maximum(place - (window - half), 0), np.minimum(place + window, len(own))
                    opens = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1] - window + 1]))
                    for a, b in zip(low[opens].tolist(), high[np.append(opens[1:], len(low)) - 1].tolist()):
                        rows.append((key, ord_, a, own[a:b]))
            if rows:
                key, ord_, at, own = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ord_), pa.array(at, pa.int32()), pa.array(own, pa.list_(pa.int64()))], ["key", "ord", "at", "codes"])

    return run


def _windows(window: int):
    """(key, ord, at, codes) -> (key, ord, at, i, w): the hash of each window of the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes = batch.column(3)[k].values.to_numpy().view(np.uint64)
                i = np.arange(len(codes) - window + 1)
                w = range_hashes(codes, WORD_POWERS, i, i + window).view(np.int64)
                same = pa.array(np.full(len(i), k))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in range(3)), pa.array(i.astype(np.int32)), pa.array(w)], ["key", "ord", "at", "i", "w"])

    return run


def _pieces(window: int, shards: int):
    """(key, ord, at, codes, found array<(i, home)>) -> (shard, asks, key, ord, at, codes): runs of windows at home here, and of those that have one home shard elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, ord_, at, codes, found in zip(*(batch.column(c) for c in range(5))):
                key, ord_, at, codes = key.as_py(), ord_.as_py(), at.as_py(), codes.values.to_numpy()
                i, home = found.values.field(0).to_numpy(), found.values.field(1).to_numpy()
                by = np.argsort(i)
                i, home = i[by], home[by]
                shard = (mixed(home.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
                for asks, chosen in ((0, home == ord_), (1, home < ord_)):
                    j, of = i[chosen], shard[chosen]
                    if len(j):
                        opens = np.flatnonzero(np.concatenate([[True], (np.diff(j) > 1) | (np.diff(of) != 0)]))
                        for a, b in zip(opens.tolist(), np.append(opens[1:], len(j)).tolist()):
                            out.append((int(of[a]), asks, key, ord_, at + int(j[a]), codes[j[a] : j[b - 1] + window]))
            if out:
                types = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["shard", "asks", "key", "ord", "at", "codes"])

    return run


class SuffixAutomaton:
    """All runs of words of several texts; each state knows the least owner of the texts that hold its runs."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.owner, self.settled = [-1], [0], [LAST], False

    def _state(self, size: int, owner: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.size.append(size)
        self.owner.append(owner)
        return len(self.next) - 1

    def _split(self, state: int, symbol: int, to: int) -> int:
        """The longest run of ``state`` and ``symbol`` as a state of its own, out of ``to``."""
        copy = self._state(self.size[state] + 1, LAST, dict(self.next[to]), self.link[to])
        while state >= 0 and self.next[state].get(symbol) == to:
            self.next[state][symbol] = copy
            state = self.link[state]
        self.link[to] = copy
        return copy

    def add(self, text: list[int], owner: int) -> None:
        last = 0
        for symbol in text:
            to = self.next[last].get(symbol)
            if to is not None:  # another text has been here
                last = to if self.size[to] == self.size[last] + 1 else self._split(last, symbol, to)
            else:
                state, last = last, self._state(self.size[last] + 1, LAST, {}, 0)
                while state >= 0 and symbol not in self.next[state]:
                    self.next[state][symbol] = last
                    state = self.link[state]
                if state >= 0:
                    to = self.next[state][symbol]
                    self.link[last] = to if self.size[to] == self.size[state] + 1 else self._split(state, symbol, to)
            self.owner[last] = min(self.owner[last], owner)
        self.settled = False

    def settle(self) -> None:
        """Owners of longer runs own their suffixes too."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.owner[self.link[state]] = min(self.owner[self.link[state]], self.owner[state])
        self.settled = True

    def matched(self, text: list[int], least: int, before: int) -> list[tuple[int, int]]:
        """Maximal spans of the text of which every word lies in a run of ``least`` words that a text of an owner smaller than ``before`` holds."""
        if not self.settled:
            self.settle()
        follow, link, size, owner = self.next, self.link, self.size, self.owner
        found: list[tuple[int, int]] = []
        state = held = 0
        for at, symbol in enumerate(text, 1):
            while state and symbol not in follow[state]:
                state = link[state]
                held = size[state]
            to = follow[state].get(symbol)
            if to is None:
                continue
            state, held = to, held + 1
            if held >= least:
                whole = state
                while size[link[whole]] >= least:
                    whole = link[whole]
                if owner[whole] < before:
                    if found and at - least <= found[-1][1]:
                        found[-1] = (found[-1][0], at)
                    else:
                        found.append((at - least, at))
        return found


def _stream(window: int):
    """Rows by (shard, block), references first: builds each shard's automaton and streams the others through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, SuffixAutomaton()
        for batch in batches:
            out = []
            shard, asks, key, ord_, at = (batch.column(c).to_pylist() for c in range(5))
            for k in range(batch.num_rows):
                if shard[k] != now:
                    now, automaton, read = shard[k], SuffixAutomaton(), set()
                text = batch.column(5)[k].values.to_pylist()
                if asks[k]:
                    out += [(key[k], at[k] + a, at[k] + b) for a, b in automaton.matched(text, window, ord_[k])]
                elif (key[k], at[k]) not in read:  # the blocks of a shard bring the same references
                    read.add((key[k], at[k]))
                    automaton.add(text, ord_[k])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32()))], ["key", "low", "high"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, spans array<(low, high)>) -> (key, n_removed, cut_sha)."""
    for batch in batches:
        out = []
        for key, text, found in zip(*(batch.column(c).to_pylist() for c in range(3))):
            runs: list[tuple[int, int]] = []
            for low, high in sorted((s["low"], s["high"]) for s in found):
                if runs and low <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(high, runs[-1][1]))
                else:
                    runs.append((low, high))
            out.append((key, *kept_words(text, runs)[1:]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "n_removed", "cut_sha"])


def text_key() -> Column:
    """Rows of one document: those that share doc_id and text."""
    return F.xxhash64("doc_id", "text")


def texts_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, ...) with each one's text; other texts are not shuffled, as far as the slots of the keys tell."""
    keyed = docs.select(text_key().alias("key"), "text").withColumn("slot", slot(F.col("key")))
    return keyed.join(slots(asked, "key"), "slot", "left_semi").select("key", "text").dropDuplicates(["key"]).join(asked, "key")


def removed_spans(rows: DataFrame, docs: DataFrame, window: int, shard_words: int, block_words: int) -> DataFrame:
    """rows (key, ord, marks, places) of texts that none is equal to -> (key, spans array<(low, high)>), words that go."""
    each = rows.select("key", "ord", F.explode(F.arrays_zip("marks", "places")).alias("m")).select("key", "ord", F.col("m.marks").alias("g"), F.col("m.places").alias("p"))
    each = written(each)
    shared = written(each.groupBy("g").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a < b").select("g"))
    met = written(each.join(shared, "g").groupBy("key").agg(F.first("ord").alias("ord"), F.collect_list("p").alias("places")))
    texts = texts_of(docs, met).select("key", "ord", "text", "places")
    segments = written(texts.mapInArrow(_segments(window), "key long, ord long, at int, codes array<long>"))

    each = written(segments.mapInArrow(_windows(window), "key long, ord long, at int, i int, w long"))
    homes = each.groupBy("w").agg(F.min("ord").alias("home"), F.max("ord").alias("far")).where("home < far").select("w", "home")
    homes = written(homes)
    shards = max(1, homes.count() // shard_words)
    found = each.join(homes, "w").groupBy("key", "at").agg(F.collect_list(F.struct("i", "home")).alias("found"))
    both = segments.join(written(found), ["key", "at"]).select("key", "ord", "at", "codes", "found")
    pieces = written(both.mapInArrow(_pieces(window, shards), "shard int, asks int, key long, ord long, at int, codes array<long>"))

    asked = pieces.where("asks = 1").groupBy("shard").agg(F.ceil(F.sum(F.size("codes")) / block_words).cast("int").alias("blocks"))
    pieces = pieces.join(written(asked), "shard")
    dealt = F.when(F.col("asks") == 1, F.array(F.pmod(F.xxhash64("key", "at"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = pieces.withColumn("block", F.explode(dealt)).repartition("shard", "block").sortWithinPartitions("shard", "asks")
    hits = dealt.select("shard", "asks", "key", "ord", "at", "codes").mapInArrow(_stream(window), "key long, low int, high int")
    return written(hits.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans")))


def dedup(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("ord"), text_key().alias("key"), F.xxhash64(F.lit(1), F.col("text")).alias("same"), "text")
    kind = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in rows.columns[:4])
    rows = written(rows.mapInArrow(_read(window), f"{kind}, n_words long, sha string, marks array<long>, places array<long>"))
    least = rows.where(F.col("n_words") >= window).groupBy("same").agg(F.min("ord").alias("least"), F.max("ord").alias("most"))
    copied = written(least.where("least < most").select("same", "least"))
    marked = rows.where(F.size("marks") > 0).join(copied, "same", "left").where(F.coalesce(F.col("ord") == F.col("least"), F.lit(True)))
    # of rows that share doc_id and text one is enough
    marked = marked.dropDuplicates(["key"]).select("key", "ord", "marks", "places")
    spans_ = removed_spans(marked, docs, window, shard_words, block_words)
    cut = written(texts_of(docs, spans_).select("key", "text", "spans").mapInArrow(_cut, "key long, n_removed long, cut_sha string"))
    slim = rows.select("doc_id", "ord", "key", "same", "n_words", "sha").join(copied, "same", "left").join(cut, "key", "left")
    whole = F.coalesce((F.col("ord") > F.col("least")) & (F.col("n_words") >= window), F.lit(False))
    return slim.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
