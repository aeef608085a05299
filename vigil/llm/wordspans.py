"""Words of whole Arrow batches as numpy positions, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21


def blocks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch of about BLOCK_BYTES, the bytes of their texts in column ``at`` and the texts' borders in them; nulls are empty."""
    if not batch.num_rows:
        return
    column = batch.column(at).fill_null("").cast(pa.large_string())
    held = column.buffers()
    borders = np.frombuffer(held[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(held[2], np.uint8) if held[2] is not None and held[2].size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(borders, borders[low] + BLOCK_BYTES, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield batch.slice(low, high - low), raw[borders[low] : borders[high]], borders[low : high + 1] - borders[low]
        low = high


def spans(is_word: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes, cut at the borders of texts, and the number of words before each border."""
    if not len(is_word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(borders), np.int64)
    opens = is_word.copy()
    opens[1:] &= ~is_word[:-1]
    closes = is_word.copy()
    closes[:-1] &= ~is_word[1:]
    inner = borders[(borders > 0) & (borders < len(is_word))]
    opens[inner] = is_word[inner]
    closes[inner - 1] = is_word[inner - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, stops, np.searchsorted(starts, borders)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places of the ranges [start, start + length) one after the other, the place within each range, and where each range begins."""
    first = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    return np.repeat(starts, lengths) + inside, inside, first
