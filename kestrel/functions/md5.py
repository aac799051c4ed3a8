"""md5 keys of many ids at once, as :func:`hashing.h` makes them: the first 64 bits of
md5('<number>|<id>'), or of md5('<number>|c|<id>'), for a batch of integer ids.

The text is one block of 64 bytes, so a key is the same 64 steps for every id; each step is a
few operations on arrays of 32-bit words, in runs that stay in the cache.
"""

from __future__ import annotations

import numpy as np

RUN = 16384
_TURN = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, np.uint32)
_SINE = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2**32).astype(np.uint64).astype(np.uint32)
_WORD = np.array([i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else (7 * i) % 16 for i in range(64)])
_START = tuple(np.array([v], np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))


def texts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal texts of integers: (bytes, one row of 20 an id from the left, lengths)."""
    ids = ids.astype(np.int64)
    minus = ids < 0
    left = np.where(minus, -ids.astype(np.uint64), ids.astype(np.uint64))
    digits = np.zeros((20, len(ids)), np.uint8)
    size = np.ones(len(ids), np.int64)
    for at in range(19, -1, -1):
        rest = left // np.uint64(10)
        digits[at] = left - rest * np.uint64(10) + np.uint64(48)
        left = rest
        if not left.any():
            break
        size += left > 0
    size += minus
    # the sign takes the place before the first digit
    at = np.flatnonzero(minus)
    digits[20 - size[at], at] = 45
    out = np.zeros((len(ids), 20), np.uint8)
    for n in np.unique(size).tolist():
        of = np.flatnonzero(size == n)
        out[of, :n] = digits[20 - n :, of].T
    return out, size


def keys(prefix: str, ids: np.ndarray | tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """First 64 bits (big-endian, as the hex text reads) of md5(prefix + text of the id), as uint64.
    ``ids`` may be given as their :func:`texts`."""
    text, size = ids if isinstance(ids, tuple) else texts(ids)
    head = np.frombuffer(prefix.encode(), np.uint8)
    if len(head) + 20 > 55:
        raise ValueError("the text of a key must fit one block")
    out = np.empty(len(size), np.uint64)
    for at in range(0, len(size), RUN):
        out[at : at + RUN] = _block(head, text[at : at + RUN], size[at : at + RUN])
    return out


def _block(head: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    n, used = len(size), len(head)
    raw = np.zeros((n, 64), np.uint8)
    raw[:, :used] = head
    raw[:, used : used + 20] = text
    raw[np.arange(n), used + size] = 128
    words = np.ascontiguousarray(raw.view("<u4").T)
    words[14] = (8 * (used + size)).astype(np.uint32)
    blank = [not words[w].any() for w in range(16)]
    a, b, c, d = (np.repeat(v, n) for v in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, _SINE[i], out=f)
        if not blank[_WORD[i]]:
            np.add(f, words[_WORD[i]], out=f)
        turn = _TURN[i]
        np.left_shift(f, turn, out=t)
        np.right_shift(f, np.uint32(32) - turn, out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)  # the old a is used up
        a, d, c, b = d, c, b, a
    a, b = a + _START[0], b + _START[1]
    return (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap().astype(np.uint64)
