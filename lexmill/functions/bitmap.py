"""A bitmap of 64-bit keys, made on the executors, by which a scan drops what no key equals. It lets a key of the table always pass, another one
seldom: with ``BITS`` bits for each key about one in 1500; the fuller a bitmap at its size limit, the more it lets pass, and the join that follows decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.arrays import BASE

#: Bits for each key, bits in all (128 MB) at most, and places that a key sets.
BITS, MOST, PLACES = 32, 1 << 30, 3


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(keys >> np.uint64(11 * p)) * (BASE if p else np.uint64(1)) & np.uint64(bits - 1) for p in range(PLACES)]


def build(keys: DataFrame, count: int) -> np.ndarray:
    """The bitmap of the ``count`` keys in the one column (bigint) of a table; at most MOST / 64 rows reach the driver, whatever the table."""
    bits = min(MOST, 1 << max(16, (max(count, 1) * BITS - 1).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    rows = keys.mapInArrow(placed, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    out = np.zeros(bits >> 6, np.uint64)
    got = rows.toArrow()
    out[got["word"].to_numpy()] = got["bit"].to_numpy().view(np.uint64)
    return out


def passed(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the keys (unsigned) are that the bitmap lets pass."""
    left = np.arange(len(keys))
    for place in _places(keys, len(bitmap) << 6):
        at = place[left]
        left = left[(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return left
