"""Vectorised word splitting and hashing over Arrow string batches.

Everything works on the UTF-8 bytes of a whole batch at once: no Python loop
touches a word.  ``Batch`` holds, for the rows of one Arrow column, the byte
range, 64-bit hash and row number of every word.

Nulls count as empty texts; a text without words has no entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_INV = pow(_P, -1, 1 << 64)

#: words are runs of anything but ASCII white space
WORD_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _pow(sign: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base (sign 1) or of its inverse (sign -1)."""
    got = _powers[sign]
    if len(got) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = np.full(size, _P if sign > 0 else _INV, np.uint64)
        base[0] = 1
        got = _powers[sign] = np.multiply.accumulate(base)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets into them) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(buffers[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return data, offsets - lo


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end)."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _pow(1, len(data)), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _pow(-1, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


class Batch:
    """Words of a batch: ``start``/``end`` bytes, ``hash``, ``row``, and ``first[i]:first[i+1]`` per row."""

    def __init__(self, col: pa.Array, lower: bool = False, space: np.ndarray = WORD_SPACE):
        self.data, self.offsets = column_bytes(col)
        if lower:
            self.data = LOWER[self.data]
        n, rows = len(self.data), len(self.offsets) - 1
        inside = ~space[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True  # a word never crosses into the next row
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.inside = inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.hash = span_hash(self.data, self.start, self.end)
        self.first = np.searchsorted(self.start, self.offsets)
        self.n = np.diff(self.first)
        self.row = np.repeat(np.arange(rows), self.n)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each word on, whether those k words lie in one row)."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    whole = np.zeros(n, bool)
    m = n - k + 1
    if m > 0:
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _pow(1, n), out=prefix[1:])
        out[:m] = mix((prefix[k:] - prefix[:m]) * _pow(-1, m))
        ends = np.repeat(first[1:], np.diff(first))
        whole = np.arange(k, n + k) <= ends
    return out, whole


def per_row_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def slices(col: pa.Array, limit: int = 1 << 20):
    """Row ranges (i, j) whose texts hold about ``limit`` bytes at most, one row at least."""
    _, offsets = column_bytes(col)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j
