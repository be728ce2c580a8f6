"""Running sums and row numbers over a global order, in two steps: totals of ranges, then inside each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column, before: str, prefix: Column) -> DataFrame:
    """df with ``before``: the sum of value over the rows that come earlier in the group.

    prefix: a value that does not fall along the order (such as the first digits of a hex key), with a bounded
    number of values; one task holds the rows of one prefix of one group."""
    keyed = df.withColumn("_p", prefix).withColumn("_v", value)
    sums = keyed.groupBy(*group, "_p").agg(F.sum("_v").alias("_n"))
    part = Window.partitionBy(*group, F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_p", F.coalesce(F.sum("_n").over(part), F.lit(0)).alias("_b"))
    inside = Window.partitionBy(*group, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # as many rows as groups x prefixes; the prefixes are at most 4096
    return keyed.join(F.broadcast(sums), [*group, "_p"]).withColumn(before, F.col("_b") + F.sum("_v").over(inside) - F.col("_v")).drop("_p", "_v", "_b")


def row_index(df: DataFrame, group: list[str], order: list[str], name: str, prefix: Column) -> DataFrame:
    """Position in the group, from 0."""
    return running_sum(df, group, order, F.lit(1).cast("bigint"), name, prefix)


def hex_prefix(c: str) -> Column:
    """4096 ranges of a hex key."""
    return F.substring(c, 1, 3)


