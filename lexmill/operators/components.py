"""Connected components by hooking to the least neighbour and pointer jumping; every step is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import Stages


def components(edges: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """v, label: the least vertex of each component. Nulls and loops join nothing; rounds grow with log(vertices)."""
    stages = Stages(edges.sparkSession)
    work = stages.put(edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where(F.col(left).isNotNull() & F.col(right).isNotNull()).where("a <> b").distinct())
    every = stages.put(work.select(F.explode(F.array("a", "b")).alias("v")).distinct())
    labels = every.select("v", F.col("v").alias("label"))
    while not work.isEmpty():
        up = work.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        up = stages.put(up)
        moved = True
        while moved:
            far = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            nxt = stages.put(up.join(far, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            moved = not nxt.where("moved").isEmpty()
            stages.drop(up)
            up = nxt
        hop = up.select("v", "p")
        new = labels.join(hop.withColumnRenamed("v", "label"), "label", "left").select("v", F.coalesce("p", "label").alias("label"))
        new = stages.put(new)
        for side in ("a", "b"):
            work = work.join(hop.withColumnRenamed("v", side), side, "left").withColumn(side, F.coalesce("p", side)).select("a", "b")
        work = stages.put(work.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        stages.drop(labels)
        labels = new
    least = labels.groupBy("label").agg(F.min("v").alias("least"))
    return labels.join(least, "label").select("v", F.col("least").alias("label"))
