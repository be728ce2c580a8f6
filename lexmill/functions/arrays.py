"""NumPy kernels over batches of texts: code points, n-gram hashes, folded words. No row-at-a-time work."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
#: Code points in one slice of work; a longer text is one slice of its own.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; works on a fresh array."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about SLICE code points."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each text starts (with the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def counts(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of true flags in each run; runs may be empty."""
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=total[1:])
    return (total[starts[1:]] - total[starts[:-1]]).astype(np.int64)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of float rows in each run; runs may be empty."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
    some = starts[1:] > starts[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, starts[:-1][some], axis=0)
    return out


def offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


_tables: dict[str, np.ndarray] = {}


def flag_table(name: str, rule) -> np.ndarray:
    """A table of one flag for each code point, made once for each worker from a rule over characters."""
    if name not in _tables:
        _tables[name] = np.fromiter((rule(chr(i)) for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _tables[name]


def is_letter(cps: np.ndarray) -> np.ndarray:
    return flag_table("letter", str.isalpha)[cps]


def is_space(cps: np.ndarray) -> np.ndarray:
    return flag_table("space", str.isspace)[cps]


def nfc(texts: list[str]) -> list[str]:
    return [t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts]


def ngrams(units: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside each run and their starts; runs shorter than n have none."""
    lengths = np.maximum(np.diff(starts) - (n - 1), 0)
    out = offsets(lengths)
    if out[-1] == 0:
        return np.zeros(0, U64), out
    total = len(units) - n + 1
    h = units[:total].astype(U64)
    for k in range(1, n):
        h *= BASE
        h += units[k : k + total]
    keep = np.zeros(total + 1, np.int8)
    some = lengths > 0
    keep[starts[:-1][some]] += 1
    keep[starts[:-1][some] + lengths[some]] -= 1
    return mix(h[np.cumsum(keep[:total], dtype=np.int8).view(bool)]), out


def word_hashes(folded: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """folded: code points, 0 between words. Gives each word's hash, its first position, and where each run's words start."""
    inside = folded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = starts[:-1][starts[:-1] < len(folded)]
    first[edge] = inside[edge]  # a word never goes on into the next text
    begin = np.flatnonzero(first)
    bounds = np.searchsorted(begin, starts)
    if not len(begin):
        return np.zeros(0, U64), begin, bounds
    at = np.arange(len(folded), dtype=np.int64)
    at -= np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(folded)]])))
    power = _powers()[at & 63]
    power *= folded
    return mix(np.add.reduceat(power, begin)), begin, bounds


def _powers() -> np.ndarray:
    if "powers" not in _tables:
        _tables["powers"] = np.cumprod(np.full(64, BASE | U64(1), U64))
    return _tables["powers"]
