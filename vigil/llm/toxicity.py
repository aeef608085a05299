"""Toxicity scores of a small bidirectional gated recurrent network, in numpy.

Inputs of each word: an embedding of its hash and the mean embedding of its hashed character
4-grams, each with a log-odds column (how much likelier the word or its strongest 4-gram is
in toxic documents). Forward and backward gated recurrent units read windows of WINDOW words;
attention pools their states into one logit. A document's score is that of its worst window;
all windows are scored, STEP words apart: each overlaps the next by half, so any run of
WINDOW - STEP + 1 words lies whole in one.

Training takes at most MAX_TOXIC toxic and MAX_OTHER other labelled documents, and at most
MAX_CHARS bytes of them (the only bounds; all else covers all data), shared out to the labels
in this proportion and filled in hash order; a text too long for the rest is passed over, and of
several texts with one doc_id the one of the least hash is asked. Documents have one
label and toxicity is local, so the window that stands for a document is chosen anew in each
round: first by the log-odds, then by the network itself (multiple-instance learning). The
log-odds used in training come from the half of the sample that does not hold the document.

Nulls: a null or empty text has no words and is scored as one empty window. Labels that are
null, or whose document is missing, are not used. Without both labels the score is 0.
Repeated rows get equal scores. An empty table gives an empty result. A very long text is
scored in full, window by window. All other columns pass through; a column named as the
score's (``into``) is replaced, and no other name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

WINDOW, STEP = 32, 16
BUCKETS = 1 << 15
EMBED, HIDDEN, ATTEND = 6, 8, 8
MAX_TOXIC, MAX_OTHER, MAX_CHARS = 1500, 2500, 16_000_000
ROUNDS, VISITS, BATCH = 2, 18_000, 128  # windows seen in each round, whatever the sample's size

#: Word bytes in lower case; 0 for all others. Values below 0x30 are free for marks.
_LETTER = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        _LETTER[_b] = _b | 0x20 if chr(_b).isupper() and _b < 0x80 else _b
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def word_codes(letters: np.ndarray, length: np.ndarray, first: int) -> np.ndarray:
    """Hashes of a block of words, from ``first`` on: the sum of letter times power over each."""
    size = length[first : first + (1 << 17)]
    start = int(length[:first].sum())
    own = letters[start : start + int(size.sum())]
    begin = np.cumsum(size) - size
    nth = np.arange(len(own)) - np.repeat(begin, size)
    return np.add.reduceat((own.astype(np.uint64) + np.uint64(1)) * _POWERS[nth % len(_POWERS)], begin)


@dataclass
class Words:
    """Words of several texts: the distinct ones, and for each text the places of its words."""

    grams: np.ndarray  # buckets of the 4-grams of all distinct words
    gram_start: np.ndarray
    bucket: np.ndarray
    place: np.ndarray  # of each word among the distinct ones
    doc_start: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        letters = _LETTER[raw]
        inside = letters != 0
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, stop = edges[::2], edges[1::2]
        doc_start = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
        if not len(start):
            none = np.zeros(0, np.int64)
            return cls(none, none, none, none, doc_start)
        length = stop - start
        code = np.concatenate([word_codes(letters[inside], length, at) for at in range(0, len(length), 1 << 17)])
        _, first, place = np.unique(code, return_index=True, return_inverse=True)
        bucket = (code[first] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(49)).astype(np.int64)
        # one 4-gram for each letter, of the word with a mark on either side
        size = length[first]
        gram_start = np.cumsum(size + 5) - (size + 5)
        text = np.zeros(int((size + 5).sum()), np.uint32)
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(gram_start + 1, size) + k] = letters[np.repeat(start[first], size) + k]
        text[gram_start] = 1
        text[gram_start + 1 + size] = 2
        own = np.repeat(gram_start, size) + k
        gram = text[own] | text[own + 1] << np.uint32(8) | text[own + 2] << np.uint32(16) | text[own + 3] << np.uint32(24)
        grams = (gram * np.uint32(0x9E3779B1) >> np.uint32(17)).astype(np.int64)
        return cls(grams, np.cumsum(size) - size, bucket, place, doc_start)

    def sizes(self) -> np.ndarray:
        return np.diff(np.concatenate([self.gram_start, [len(self.grams)]]))


def windows(doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and document of each window; the last of a document ends with it."""
    size = np.diff(doc_start)
    count = np.maximum(1, -(-(size - WINDOW) // STEP) + 1)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(nth * STEP, np.maximum(size[doc] - WINDOW, 0))
    return doc_start[:-1][doc] + first, np.minimum(size[doc], WINDOW), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights, the scoring pass and the gradients."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        draw = lambda *shape: (g.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.word, self.gram = (0.1 * g.normal(size=(BUCKETS, EMBED)).astype(np.float32) for _ in range(2))
        self.word_odds, self.gram_odds = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
        x = 2 * EMBED + 2
        self.p = {
            "W": draw(x, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, np.float32),
            "U": np.stack([draw(HIDDEN, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN)]),
            "A": draw(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": draw(ATTEND),
            "o": draw(2 * HIDDEN), "c": np.zeros(1, np.float32),
        }

    def inputs(self, w: Words, odds=None) -> np.ndarray:
        word_odds, gram_odds = odds or (self.word_odds, self.gram_odds)
        if not len(w.bucket):
            return np.zeros((0, 2 * EMBED + 2), np.float32)
        mean = np.add.reduceat(self.gram[w.grams], w.gram_start) / w.sizes()[:, None].astype(np.float32)
        most = np.maximum.reduceat(gram_odds[w.grams], w.gram_start)
        return np.concatenate([self.word[w.bucket], mean, word_odds[w.bucket, None], most[:, None]], axis=1).astype(np.float32)

    def forward(self, gates: np.ndarray, index: np.ndarray, live: np.ndarray | None, keep: bool = False):
        """gates: input part of each distinct word; index: (windows, words) among them. Logits, and what the gradients need."""
        p, (n, steps), h3 = self.p, index.shape, 3 * HIDDEN
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        held = {}
        for way in (0, 1):
            h, own = np.zeros((n, HIDDEN), np.float32), gates[:, way * h3 : (way + 1) * h3]
            for t in range(steps) if way == 0 else reversed(range(steps)):
                x, u = own[index[:, t]], h @ p["U"][way]
                rz = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                next_h = new + z * (h - new)
                if live is not None:
                    next_h *= live[:, t, None]
                if keep:
                    held[way, t] = h, r, z, new, u[:, 2 * HIDDEN :]
                h = states[t, :, way * HIDDEN : (way + 1) * HIDDEN] = next_h
        look = np.tanh(states @ p["A"] + p["a"])
        score = look @ p["v"]
        if live is not None:
            score = np.where(live.T > 0, score, -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        logit = pooled @ p["o"] + p["c"]
        return logit, (states, held, look, weight, pooled)

    def backward(self, d_logit: np.ndarray, index: np.ndarray, live: np.ndarray, memory) -> tuple[dict, np.ndarray]:
        """Gradients of the weights, and those of the gates of each (window, word)."""
        p, (states, held, look, weight, pooled) = self.p, memory
        steps, n, _ = states.shape
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["c"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["o"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tna,tn->a", look, d_score)
        d_look = d_score[:, :, None] * p["v"] * (1 - look**2)
        g["A"], g["a"] = np.einsum("tnh,tna->ha", states, d_look), d_look.sum(axis=(0, 1))
        d_states = d_states + d_look @ p["A"].T
        d_gates = np.zeros((n, steps, 6 * HIDDEN), np.float32)
        for way in (0, 1):
            carry, base = np.zeros((n, HIDDEN), np.float32), way * 3 * HIDDEN
            for t in reversed(range(steps)) if way == 0 else range(steps):
                h, r, z, new, un = held[way, t]
                d = (carry + d_states[t, :, way * HIDDEN : (way + 1) * HIDDEN]) * live[:, t, None]
                d_new = d * (1 - z) * (1 - new**2)
                d_z = d * (h - new) * z * (1 - z)
                d_r = d_new * un * r * (1 - r)
                d_u = np.concatenate([d_r, d_z, d_new * r], axis=1)
                g["U"][way] += h.T @ d_u
                carry = d * z + d_u @ p["U"][way].T
                d_gates[:, t, base : base + 3 * HIDDEN] = np.concatenate([d_r, d_z, d_new], axis=1)
        return g, d_gates

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input part of the gates of each distinct word, and of a missing one at the end."""
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        return x @ self.p["W"] + self.p["b"]

    def score_windows(self, w: Words, gates: np.ndarray, batch: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Logit and document of each window."""
        first, size, doc = windows(w.doc_start)
        logits = np.empty(len(first), np.float32)
        for whole in (True, False):
            chosen = np.flatnonzero((size == WINDOW) == whole)
            for at in range(0, len(chosen), batch):
                own = chosen[at : at + batch]
                index, live = spread(w, first[own], size[own], len(gates) - 1)
                logits[own] = self.forward(gates, index, None if whole else live)[0]
        return logits, doc

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The worst window of each text, as a probability."""
        if not texts:
            return np.zeros(0)
        w = Words.of(texts)
        logits, doc = self.score_windows(w, self.gates(self.inputs(w)))
        first = np.searchsorted(doc, np.arange(len(texts)))
        return _sigmoid(np.maximum.reduceat(logits, first).astype(np.float64))


def spread(w: Words, first: np.ndarray, size: np.ndarray, missing: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of each window, ``missing`` beyond its end; which are there."""
    steps = np.arange(WINDOW)
    live = steps < size[:, None]
    if not len(w.place):
        return np.full(live.shape, missing), live.astype(np.float32)
    return np.where(live, w.place[np.minimum(first[:, None] + steps, len(w.place) - 1)], missing), live.astype(np.float32)


def log_odds(w: Words, toxic: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much likelier each bucket is in toxic documents; drawn to 0 where it is rare."""
    sizes, counts = w.sizes(), np.zeros((2, 2, BUCKETS), np.int64)  # words or grams, not toxic or toxic
    for doc in np.flatnonzero(chosen).tolist():
        place = np.unique(w.place[w.doc_start[doc] : w.doc_start[doc + 1]])
        n = sizes[place]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        grams = w.grams[np.repeat(w.gram_start[place], n) + k]
        for kind, bucket in enumerate((w.bucket[place], grams)):
            counts[kind, int(toxic[doc]), np.unique(bucket)] += 1
    n_no, n_yes = (~toxic & chosen).sum(), (toxic & chosen).sum()
    odds = np.log((counts[:, 1] + 0.5) / (n_yes + 1)) - np.log((counts[:, 0] + 0.5) / (n_no + 1))
    seen = counts.sum(axis=1)
    odds = (odds * seen / (seen + 4)).astype(np.float32)
    return odds[0], odds[1]


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 7) -> Network:
    net, g = Network(seed), np.random.default_rng(seed)
    w = Words.of(texts)
    fold = g.permutation(len(texts)) % 2 == 1
    halves = [log_odds(w, toxic, fold == half) for half in (False, True)]  # of the documents not in the other half
    net.word_odds, net.gram_odds = log_odds(w, toxic, np.ones(len(texts), bool))
    first, size, doc = windows(w.doc_start)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    rare = [np.full((BUCKETS, 1), 1e-2, np.float32) for _ in range(2)]
    step = 0
    balance = np.where(toxic, (~toxic).sum() / max(1, toxic.sum()), 1.0).clip(1, 4)
    for round_ in range(ROUNDS + 1):
        # the window that stands for each document
        strength = np.empty(len(first), np.float32)
        for half in (0, 1):
            x = net.inputs(w, halves[1 - half])  # odds that have not seen the document
            own = np.flatnonzero(fold[doc] == bool(half))
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                index, live = spread(w, first[part], size[part], len(x))
                if round_ == 0:
                    strength[part] = np.append(x[:, -1] + x[:, -2], -99)[index].max(axis=1)
                else:
                    strength[part] = net.forward(net.gates(x), index, live)[0]
        if round_ == ROUNDS:
            settle(net, np.maximum.reduceat(strength, np.searchsorted(doc, np.arange(len(texts)))), toxic)
            break
        order = np.lexsort((-strength, doc))
        ranked = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        chosen = order[ranked < np.where(toxic[doc[order]], 1, 3)]
        for _ in range(-(-VISITS // len(chosen))):
            for at in np.array_split(g.permutation(chosen), max(1, len(chosen) // BATCH)):
                step += 1
                half = fold[doc[at]]
                index, live = spread(w, first[at], size[at], len(w.bucket))
                used, local = np.unique(index, return_inverse=True)
                local = local.reshape(index.shape)
                there = used[used < len(w.bucket)]
                n = w.sizes()[there]
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                grams = w.grams[np.repeat(w.gram_start[there], n) + k]
                sub = Words(grams, np.cumsum(n) - n, w.bucket[there], there, w.doc_start)
                loss_to = np.zeros((len(there) + 1, 2 * EMBED + 2), np.float32)
                for side in (False, True):  # each half with the other's odds
                    rows = np.flatnonzero(half == side)
                    if not len(rows):
                        continue
                    x = net.inputs(sub, halves[not side] if len(there) else None)
                    logit, memory = net.forward(net.gates(x), local[rows], live[rows], keep=True)
                    y = toxic[doc[at[rows]]]
                    d = (_sigmoid(logit) - y) * balance[doc[at[rows]]] / len(at)
                    grad, d_gates = net.backward(d.astype(np.float32), local[rows], live[rows], memory)
                    full = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])[local[rows]]
                    grad["W"] = np.einsum("ntx,ntg->xg", full, d_gates)
                    grad["b"] = d_gates.sum(axis=(0, 1))
                    np.add.at(loss_to, local[rows], d_gates @ net.p["W"].T)
                    for key, value in net.p.items():
                        m, s = moments[key]
                        m += 0.1 * (grad[key] - m)
                        s += 0.01 * (grad[key] ** 2 - s)
                        value -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
                loss_to = loss_to[:-1]
                for table, memory, rows, d in (
                    (net.word, rare[0], sub.bucket, loss_to[:, :EMBED]),
                    (net.gram, rare[1], grams, np.repeat(loss_to[:, EMBED : 2 * EMBED] / np.maximum(n, 1)[:, None], n, axis=0)),
                ):
                    np.add.at(memory, rows, (d**2).sum(axis=1, keepdims=True))
                    np.add.at(table, rows, -0.02 * d / np.sqrt(memory[rows]))
    return net


def settle(net: Network, logits: np.ndarray, toxic: np.ndarray, at: float = 0.7) -> None:
    """Move the bias so that the score ``at`` lies midway between the two kinds, if they are apart; the fewer toxic rows tell, the less."""
    low, high = np.quantile(logits[~toxic], 0.999), np.quantile(logits[toxic], 0.02)
    if low < high:
        told = toxic.sum() / (toxic.sum() + 20)
        net.p["c"] += np.float32(told * (np.log(at / (1 - at)) - (low + high) / 2))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The bounded sample: ids first, from the labels alone, then their texts."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = F.xxhash64("doc_id")
    parts = [known.where(F.col("toxic") == y).orderBy(drawn, "doc_id").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_OTHER))]
    sample = parts[0].union(parts[1])  # MAX_TOXIC + MAX_OTHER rows at most
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("length(text) > 0")
        .select("text", "toxic", drawn.alias("drawn"), F.xxhash64("doc_id", "text").alias("key"))
    )
    left, chosen = {1: MAX_CHARS * MAX_TOXIC // (MAX_TOXIC + MAX_OTHER), 0: MAX_CHARS * MAX_OTHER // (MAX_TOXIC + MAX_OTHER)}, []
    # as many rows as the sample has ids, whatever the documents
    each = rows.groupBy("drawn", "toxic").agg(F.min(F.struct("key", F.octet_length("text").alias("n"))).alias("text"))
    for drawn, y, (key, n) in sorted(each.collect()):
        if n <= left[y]:
            left[y] -= n
            chosen.append((key,))
    if not chosen:
        return [], np.zeros(0, bool)
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "key long")), "key").dropDuplicates(["key"])
    found = [(row["drawn"], row["toxic"], bytes(row["text"])) for row in rows.withColumn("text", F.col("text").cast("binary")).collect()]
    found.sort()
    return [t for _, _, t in found], np.array([y == 1 for _, y, _ in found], bool)


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    texts, toxic = training_rows(docs, labels)
    return train(texts, toxic) if toxic.any() and not toxic.all() else None


def score(docs: DataFrame, net: Network | None, part_bytes: int = 1 << 21, into: str = "score") -> DataFrame:
    """docs with a column ``into``: the text's probability to be toxic; one of that name is replaced."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    own = [c for c in docs.columns if c != into]
    docs = docs.select(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, scores, held, size = batch.column(batch.schema.get_field_index("text")), [], [], 0
            for text in column:
                held.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size > part_bytes:
                    scores.append(model.value.score(held) if model.value else np.zeros(len(held)))
                    held, size = [], 0
            scores.append(model.value.score(held) if model.value else np.zeros(len(held)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores), pa.float64())], [*batch.schema.names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))
