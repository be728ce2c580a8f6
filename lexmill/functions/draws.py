"""Draws of a bootstrap by hash, many at a time.

Draw ``position`` of replicate ``r`` is the first 48 bits of MD5("seed:r:position"), modulo the number of documents. A message is one block
of MD5, so all positions with equally many digits are hashed together, by array operations on pieces that fit the cache.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PIECE = 16_384
_K = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFT = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first48(words: list) -> np.ndarray:
    """The first six bytes of the digests as a number, for one-block messages whose 16 words are arrays, or ints where all messages agree."""
    m = next(len(w) for w in words if not isinstance(w, int))
    a, b, c, d = (np.full(m, x, np.uint32) for x in _START)
    f, t = np.empty(m, np.uint32), np.empty(m, np.uint32)
    for i in range(64):
        k, at = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if k == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif k == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif k == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        w = words[at]
        np.add(f, a, out=f)
        if isinstance(w, int):
            np.add(f, np.uint32((_K[i] + w) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, np.uint32(_K[i]), out=f), np.add(f, w, out=f)
        s = _SHIFT[k][i % 4]
        np.left_shift(f, np.uint32(s), out=t), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    a, b = (np.add(x, np.uint32(start)) for x, start in zip((a, b), _START))
    return (a.byteswap().astype(np.int64) << 16) | (b.byteswap() >> np.uint32(16)).astype(np.int64)


@lru_cache(maxsize=64)
def _suffixes(n: int, before: int) -> list[list]:
    """The words of the blocks of positions 0 to n - 1, without the ``before`` bytes that come first."""
    out, low, digits = [], 0, 1
    while low < n:
        high = min(n, 10**digits)
        for start in range(low, high, PIECE):
            at = np.arange(start, min(high, start + PIECE))
            block = np.zeros((len(at), 64), np.uint8)
            for j in range(digits):
                block[:, before + j] = at // 10 ** (digits - 1 - j) % 10 + 48
            block[:, before + digits] = 0x80
            block[:, 56] = (before + digits) * 8 % 256
            block[:, 57] = (before + digits) * 8 // 256
            words = np.ascontiguousarray(block.view("<u4").T)
            out.append([w.copy() if j * 4 <= before + digits - 1 and j * 4 + 4 > before else int(w[0]) for j, w in enumerate(words)])
        low, digits = high, digits + 1
    return out


def times(seed: int, replicate: int, n: int) -> np.ndarray:
    """How often each of n documents is drawn in a replicate."""
    prefix = f"{seed}:{replicate}:".encode()
    heads = np.frombuffer(prefix.ljust(64, b"\0"), "<u4")
    out = np.zeros(n, np.int64)
    for words in _suffixes(n, len(prefix)):
        own = [w | int(h) if isinstance(w, int) else (w | h if h else w) for w, h in zip(words, heads)]
        out += np.bincount(_first48(own) % n, minlength=n)
    return out
