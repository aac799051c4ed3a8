"""Vectorised word work on Arrow text columns.

A record batch's text column is one byte buffer plus offsets, so words, shingles and
hashes of many documents are computed by a few NumPy passes over the buffer.  Words
never cross documents.  Two word classes are used:

* ``SPACE`` words: ``[^\\x20\\x09-\\x0D]+``
* ``ALNUM`` words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``  (after lower-casing A-Z)

Both work on UTF-8 bytes because every byte of a multi-byte character is >= 0x80.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
ALNUM = np.ones(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = False
ALNUM[0x41:0x5B] = False  # upper-case letters are folded first
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

#: bytes of text handled by one NumPy pass (a longer document is a pass of its own)
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64) of a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base mod 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base & _MASK, pow(base, -1, 1 << 64)
        self.p = self.q = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) < n:
            n = max(n, 2 * len(self.p), SLICE_BYTES)
            for name, b in (("p", self.base), ("q", self.inv)):
                a = np.full(n, np.uint64(b))
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.p, self.q


POWERS = Powers(_BASE)
#: a 64-bit value for every byte
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, size: int = SLICE_BYTES):
    """Ranges of documents of about ``size`` bytes each."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE):
    """Words of a slice: (start, end) byte positions and the first word of each
    document (one more entry than documents)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    is_sep = sep[data]
    begin = np.empty(n, bool)
    begin[0] = True
    begin[1:] = is_sep[:-1]
    inner = off[1:-1]
    begin[inner[inner < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = is_sep[1:]
    last[inner[inner > 0] - 1] = True
    word = ~is_sep
    s = np.flatnonzero(begin & word)
    e = np.flatnonzero(last & word) + 1
    return s, e, np.searchsorted(s, off)


def prefix(data: np.ndarray, powers: Powers = POWERS, table: np.ndarray = BYTES) -> np.ndarray:
    """H with H[e] - H[s] the (shifted) polynomial hash of data[s:e]."""
    p, _ = powers.upto(len(data) + 1)
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.cumsum(table[data] * p[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    _, q = powers.upto(len(h) + 1)
    return (h[e] - h[s]) * q[s]


def word_hashes(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE):
    """Hash of every lower-cased (A-Z) word, and the first word of each document."""
    low = FOLD[data]
    s, e, first = words(low, off, sep)
    h = span_hash(prefix(low), s, e)
    return mix(h + (e - s).astype(np.uint64)), first


def shingle_hashes(w: np.ndarray, first: np.ndarray, k: int):
    """Hashes of the k-word shingles of each document; a document with fewer (but
    some) words gives its whole sequence as one.  Returns hashes and the first
    shingle of each document."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(n)), count)
    pos = first[:-1][doc] + np.arange(begin[-1]) - begin[:-1][doc]
    size = np.minimum(n, k)[doc]
    h = np.zeros(len(pos), np.uint64)
    mult = np.uint64(0xA0761D6478BD642F)
    for j in range(k):
        inside = size > j
        nxt = mix(h * mult + w[np.where(inside, pos + j, 0)] + np.uint64(j + 1)) if len(w) else h
        h = np.where(inside, nxt, h)
    return h, begin
