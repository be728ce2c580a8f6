"""Pairs inside groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more items than this is joined in blocks of half the size.
HOT = 2000


def block_pairs(rows: DataFrame, key: str, item: str, size: str, hot: int = HOT) -> DataFrame:
    """l, r: all unordered pairs of items with one key. A group of over ``hot`` items (``size``) is cut into blocks
    by a hash, and each pair of blocks is joined by itself. Equal items make no pair."""
    blocks = F.when(F.col(size) > hot, F.ceil(F.col(size) / (hot / 2))).otherwise(F.lit(1)).cast("int")
    base = rows.select(F.col(key).alias("k"), F.col(item).alias("i"), blocks.alias("n")).withColumn("b", F.pmod(F.xxhash64("i", F.lit(17)), F.col("n")).cast("int"))
    left = base.select("k", F.col("i").alias("x"), F.col("b").alias("bl"), F.explode(F.sequence("b", F.col("n") - 1)).alias("br"))
    right = base.select("k", F.col("i").alias("y"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("bl"), F.col("b").alias("br"))
    met = left.join(right, ["k", "bl", "br"]).where("x < y or (bl < br and x <> y)")
    return met.select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("r"))
