"""Words, word hashes and window hashes of an Arrow string column, vectorized over the whole batch.

A word is a run of bytes other than space and 0x09-0x0D; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32
# lower-case letters and bytes above ASCII; everything else becomes a space
LETTERS = np.where((SAME >= 0x80) | ((LOWER >= 0x61) & (LOWER <= 0x7A)), LOWER, 0x20).astype(np.uint8)

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; text i is bytes[offsets[i]:offsets[i + 1]]. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a batch of texts: `start` and `end` in `raw`, and `first[i]:first[i + 1]` of text i."""

    def __init__(self, column: pa.Array, table: np.ndarray = SAME):
        raw, self.offsets = text_bytes(column)
        self.raw = raw if table is SAME else table[raw]
        inside = IS_WORD[self.raw]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        edge = self.offsets[self.offsets < len(raw)]
        before[edge] = False  # a text starts here
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        last = self.offsets[1:] - 1
        after[last[last >= 0]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def lanes(self) -> np.ndarray:
        """The 8 bytes at every place, as unaligned little-endian numbers."""
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        return np.ndarray((len(self.raw) + 1,), "<u8", padded, strides=(1,))

    def hashes(self, seed: int = 0, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of every word, or of its first `most` bytes."""
        length = (self.end - self.start).astype(np.int64)
        if most is not None:
            length = np.minimum(length, most)
        h = length.astype(np.uint64) * M1 + np.uint64(seed)
        lanes, live, at = self.lanes(), np.arange(len(self.start)), 0
        while len(live):
            left = length[live] - 8 * at
            lane = lanes[self.start[live] + 8 * at].astype(np.uint64)
            part = left < 8
            lane[part] &= (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
            h[live] = mix((h[live] ^ lane) * M1 + M3)
            at += 1
            live = live[left > 8]
        return h


def window_hashes(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A hash of every `n` consecutive word hashes (the caller drops windows across texts)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, seed, np.uint64)
    by = M1 if seed == 1 else M2 + np.uint64(2 * seed)
    for j in range(n):
        out *= by
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def window_text(first: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of all windows of `n` words that lie inside one text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    base = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - base[text] + first[:-1][text], text


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, so that arrays over the bytes stay small."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi
