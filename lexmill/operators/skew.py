"""Joins with a table of one row for each key, where some keys hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this, and with more than the share, is hot. So there are at most 1 / SHARE hot keys.
ROWS, SHARE = 100_000, 0.001


def lookup(rows: DataFrame, table: DataFrame, key: str, count: int, how: str = "inner", most: int = ROWS) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each key). Where ``rows`` (``count`` of them) can have hot keys, those are counted, and their few rows
    of ``table`` are broadcast: no task holds all rows of a hot key. The other keys are joined by a shuffle."""
    if count <= most:
        return rows.join(table, key, how)
    limit = max(most, int(SHARE * count))
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(key)
    names = [r[0] for r in hot.collect()]  # at most 1 / SHARE keys
    if not names:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(names), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key, how).unionByName(rows.where(~is_hot).join(table.where(~is_hot), key, how))
