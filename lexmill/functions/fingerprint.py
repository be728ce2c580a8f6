"""Bottom-k fingerprints of character strings and their band keys: Arrow batches give the fingerprints, the JVM digests them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lexmill.functions import arrays as A

# Number of hashes, of bands, width of a string, base of the hash.
SIZE, BANDS, WIDTH, BASE = 32, 8, 5, 1_000_003


def _hashes(compacted: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes (mod 2^64) of the strings of ``width`` characters of all texts, and where each text's begin."""
    cps, starts = A.points(compacted)
    at = A.offsets(np.maximum(np.diff(starts) - width + 1, 0))
    total = max(len(cps) - width + 1, 0)
    h = np.zeros(total, np.uint64)
    for k in range(width if total else 0):
        h = h * np.uint64(BASE) + cps[k : k + total]
    owner = np.repeat(np.arange(len(compacted)), np.diff(at))
    return h[np.arange(at[-1]) - at[owner] + starts[owner]], at


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` least distinct values, in order."""
    if len(h) > 8 * size:  # they stand among the least 4 x size values, unless those repeat a lot
        part = np.unique(np.partition(h, 4 * size)[: 4 * size])
        if len(part) >= size:
            return part[:size]
    return np.unique(h)[:size]


def fingerprints(texts: list[str], width: int = WIDTH, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """For each text its ``size`` least distinct hashes (mod 2^64), and how many of them are hashes: a text with fewer strings is filled up
    from its digest, with numbers that stand above 2^64, of which the low 64 bits are kept; a blank one has the numbers from 0."""
    out = np.tile(np.arange(size, dtype=np.uint64), (len(texts), 1))
    count = np.zeros(len(texts), np.int64)
    for a, b in A.slices(texts):
        words = [" ".join(t.split()) for t in texts[a:b]]
        h, at = _hashes(words, width)
        for i, text in enumerate(words):
            if not text:
                count[a + i] = size
                continue
            whole = len(text) <= width
            found = np.array([int(hashlib.sha256(text.encode()).hexdigest()[:16], 16)], np.uint64) if whole else _least(h[at[i] : at[i + 1]], size)
            n = count[a + i] = len(found)
            out[a + i, :n] = found
            if n < size:
                digest = np.frombuffer(hashlib.sha256(texts[a + i].encode("utf-8", "surrogatepass")).digest(), np.uint8).astype(np.uint64)
                place = np.arange(n, size, dtype=np.uint64)
                out[a + i, n:] = digest[place % np.uint64(len(digest))] * np.uint64(size) + place
    return out, count


def bottom_k(text: str, width: int = WIDTH, size: int = SIZE) -> list[int]:
    """The fingerprint of one text, with what fills it up above 2^64."""
    values, count = fingerprints([text], width, size)
    return [int(v) + ((1 << 64) if i >= count[0] else 0) for i, v in enumerate(values[0])]


@F.pandas_udf(ArrayType(LongType()))
def _prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        values, _ = fingerprints(["" if t is None else t for t in batch])
        yield pd.Series(list(values.view(np.int64)), index=batch.index).where(batch.notna(), None)


def band_keys(values: Column, size: int = SIZE, bands: int = BANDS) -> Column:
    """For each band, 128 bits of the digest of its values as 64-bit big-endian numbers, in hex; null for no fingerprint."""
    if size % bands:
        raise ValueError("the fingerprint does not divide into the bands")
    rows = size // bands
    raw = lambda b: F.unhex(F.array_join(F.transform(F.slice(values, b * rows + 1, rows), lambda v: F.lpad(F.hex(v), 16, "0")), ""))
    return F.when(values.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.substring(F.sha2(raw(b), 256), 1, 32)))


# declared so that the fingerprint is not computed once for each band
_prints = _prints.asNondeterministic()


def prints_of(text: Column) -> Column:
    """The fingerprint as an array of 64-bit values; select it before ``band_keys``."""
    return _prints(text)
