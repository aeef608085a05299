"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents keep their order. A window may end after any document (no penalty), after any
sentence (``sentence_penalty`` tokens), before one word in each ``word_step`` tokens (which
truncates a sentence: ``word_penalty``) or, inside a word longer than the window, at a
sixteenth of it (``hard_penalty``). Among all such cuts the program picks those with the least
padding plus penalties:

    best[j] = length - t[j] + penalty[j] + min over i, t[j] - t[i] <= length, of best[i] + t[i]

and the minimum over that sliding range is kept in a monotone queue, so the work is linear.
Each Spark partition is packed on its own, in runs of ``run_tokens`` tokens at most, which
bounds memory and costs one partly filled window for each run. Nothing is shuffled.

Nulls: a null text is an empty one; an empty document is its end mark alone. Repeated rows
are separate documents. An empty table gives an empty result. Only doc_id and text are read,
so extra columns take no part and cannot clash. A very long text is cut like any other; what
is held at once is one text and a run of ``run_tokens``.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END_MARK = np.zeros(1, np.uint32)
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

_UNUSUAL = re.compile("[^\\n\\x20-\\x7e\\xa1-\\u024f]")
_BLANKS = re.compile(r"\s\s")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts as the vocabulary file gives them, and which tokens may be followed by a cut.

    Plain texts (printable Latin letters, blanks and line ends, none of the file's added
    tokens) are encoded from the same vocabulary's ranks, which gives the same ids several
    times faster. Where no two blanks meet, the word pattern's look-ahead decides nothing and
    is left out, for a third of the time. All other texts go to the vocabulary file, which is
    loaded when the first of them comes.
    """

    def __init__(self, path: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.made = path, {}
        with open(ranks, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        with open(path, "rb") as file:
            added = json.load(file).get("added_tokens") or []
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added) or "(?!)")
        size = max([*self.ranks.values(), *(t["id"] for t in added)]) + 1
        self.stops, self.opens, self.line = (np.zeros(size, bool) for _ in range(3))
        for token, i in self.ranks.items():
            self.stops[i], self.opens[i], self.line[i] = token[-1:] in b".!?", token[:1].isspace(), token == b"\n"

    def by(self, kind: str):
        if kind not in self.made:
            if kind == "file":
                from tokenizers import Tokenizer

                self.made[kind] = Tokenizer.from_file(self.path)
            else:
                import tiktoken
                from public_tokenizers import PATTERN

                pattern = PATTERN if kind == "blanks" else PATTERN.replace(r"\s+(?!\S)|", "")
                self.made[kind] = tiktoken.Encoding(kind, pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self.made[kind]

    def __call__(self, text: str) -> np.ndarray:
        if _UNUSUAL.search(text) or self.added.search(text):
            return np.array(self.by("file").encode(text, add_special_tokens=False).ids, np.uint32)
        return self.by("blanks" if _BLANKS.search(text) else "plain").encode_to_numpy(text)

    def cuts(self, ids: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Token offsets at which sentences end, and one word start in each ``step`` tokens."""
        opens = self.opens[ids[1:]]
        sentence = self.line[ids[:-1]] | (self.stops[ids[:-1]] & opens)
        word = np.flatnonzero(opens) + 1
        word = word[np.flatnonzero(np.diff(word // step, prepend=0))]
        return np.flatnonzero(sentence) + 1, word


def best_cuts(offsets: list[int], penalties: list[int], length: int) -> list[int]:
    """offsets: allowed cuts, from 0 to the end, no gap over ``length``. The cheapest cuts, without 0."""
    best, back = [0] * len(offsets), [0] * len(offsets)
    queue = deque([(0, 0, 0)])  # (best + offset, offset, index), least first
    for j in range(1, len(offsets)):
        t = offsets[j]
        while t - queue[0][1] > length:
            queue.popleft()
        least, _, back[j] = queue[0]
        cost = best[j] = least + length - t + penalties[j]
        while queue and queue[-1][0] >= cost + t:
            queue.pop()
        queue.append((cost + t, t, j))
    cuts, j = [], len(offsets) - 1
    while j:
        cuts.append(offsets[j])
        j = back[j]
    return cuts[::-1]


def candidates(doc_ends, sentence_ends, word_starts, length: int, sentence_penalty: int, word_penalty: int, hard_penalty: int):
    """Allowed cuts of a run, sorted, with their penalties; where several apply, the least."""
    kinds = [([0], 0), (doc_ends, 0), (sentence_ends, sentence_penalty), (word_starts, word_penalty)]
    at = np.concatenate([k for k, _ in kinds])
    cost = np.concatenate([np.full(len(k), c, np.int64) for k, c in kinds])
    at, first = np.unique(at, return_index=True)  # the first kind that has it
    cost = cost[first]
    step = length // 16
    hard = [np.arange(a + step, b, step) for a, b in zip(at[:-1], at[1:]) if b - a > length]
    if hard:
        hard = np.concatenate(hard)
        at, cost = np.concatenate([at, hard]), np.concatenate([cost, np.full(len(hard), hard_penalty)])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at.tolist(), cost.tolist()


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class _Run:
    """Documents of one run: their ids, ends, sentence ends and word starts."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.docs: list = []
        self.ends: list[int] = []
        self.sentences: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc, ids: np.ndarray, sentences: np.ndarray, words: np.ndarray) -> None:
        self.sentences.append(sentences + self.tokens)
        self.words.append(words + self.tokens)
        self.ids += (ids, END_MARK)
        self.tokens += len(ids) + 1
        self.docs.append(doc)
        self.ends.append(self.tokens)

    def pieces(self, first: int, length: int, with_ids: bool, **costs) -> tuple[pa.RecordBatch, int]:
        ends = np.array(self.ends, np.int64)
        allowed = candidates(ends, np.concatenate(self.sentences), np.concatenate(self.words), length, **costs)
        cuts = np.array(best_cuts(*allowed, length))
        stops = np.union1d(ends, cuts)
        starts = np.concatenate([[0], stops[:-1]])
        doc, sequence = np.searchsorted(ends, starts, "right"), np.searchsorted(cuts, starts, "right")
        doc_start, sequence_start = np.concatenate([[0], ends])[doc], np.concatenate([[0], cuts])[sequence]
        ids = np.concatenate(self.ids).astype("<u4").tobytes()
        blobs = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist())]
        columns = [
            pa.array([self.docs[d] for d in doc.tolist()], pa.int64()),
            pa.array(starts - doc_start), pa.array(stops - starts),
            pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
            pa.array(ends[doc] - doc_start), pa.array(sequence + first), pa.array(starts - sequence_start),
        ]
        names = FIELDS
        if with_ids:
            columns.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in blobs], pa.list_(pa.int32())))
            names = [*FIELDS, "ids"]
        return pa.RecordBatch.from_arrays(columns, names), first + len(cuts)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    """One for each Python worker and vocabulary."""
    key = vocabulary or vocabulary_path(VOCABULARY), ranks or vocabulary_path(RANKS)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def pack(
    docs: DataFrame, length: int = WINDOW, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False,
    sentence_penalty: int = 8, word_penalty: int = 24, hard_penalty: int = 64, word_step: int = 24, run_tokens: int = 1 << 21,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence (padded to ``length``)."""

    costs = {"sentence_penalty": sentence_penalty, "word_penalty": word_penalty, "hard_penalty": hard_penalty}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        held, first = _Run(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                held.add(doc, ids, *encode.cuts(ids, word_step))
                if held.tokens >= run_tokens:
                    out, first = held.pieces(first, length, with_ids, **costs)
                    yield out
                    held = _Run()
        if held.docs:
            yield held.pieces(first, length, with_ids, **costs)[0]

    schema = ", ".join(f"{c} long" for c in FIELDS) + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
