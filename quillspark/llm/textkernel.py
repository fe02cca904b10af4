"""Vectorised text primitives over Arrow string buffers.

A batch of texts is one UTF-8 byte buffer with row offsets; words, word hashes and
n-gram hashes come from whole-buffer numpy passes without a Python string per word.
Hashes are 64-bit sums of a random byte table times powers of an odd base, mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer single text is handled alone); with a little to spare, so that tables of powers fit.
SLICE_BYTES = (1 << 20) - 64

_U = np.uint64
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def clear() -> None:
    """Forget the kept powers."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of about ``limit`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some rows: byte spans, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        is_word = IS_WORD[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate([[False], is_word[:-1]]) if n else is_word
        after = np.concatenate([is_word[1:], [False]]) if n else is_word
        self.starts = np.flatnonzero(is_word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_TABLE_LOWER if lower else _TABLE)[self.data] * powers(_BASE, n), out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * powers(_INVERSE, n + 1)[self.starts])

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k items (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    q = powers(0xD1342543DE82EF95, k)
    for j in range(k):
        out += h[j : j + n] * q[j]
    return mix(out)


def byte_ngrams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k bytes."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_INVERSE, n))


def window_ok(first: np.ndarray, n_items: int, k: int) -> np.ndarray:
    """For each of n_items - k + 1 starts: do k items from there stay in one row? first: item offsets of rows."""
    n = n_items - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    counts = np.diff(first)
    end = np.repeat(first[1:], counts)[:n]
    return np.arange(n) + k <= end


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min of each w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have, size = x, 1
    while size * 2 <= w:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return have[:n] if size == w else np.minimum(have[:n], have[w - size : w - size + n])


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    return ~sliding_min(~x, w)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n items lie in one of the spans."""
    depth = np.zeros(n + 1, dtype=np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def pair_ranks(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dense rank of each pair of small non-negative numbers, their order; equal pairs in order of place)."""
    n = len(high)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, width = int(n - 1).bit_length(), int(low.max()).bit_length()
    if int(high.max()).bit_length() + width + place <= 63:  # one sort of numbers, the place in their last bits
        key = high.astype(np.int64)
        key <<= width
        key |= low
        key <<= place
        key |= np.arange(n)
        key.sort()
        order = key & ((1 << place) - 1)
        key >>= place
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((low, high))
        new = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order[0]] = 0
    rank[order[1:]] = np.cumsum(new)
    return rank, order
