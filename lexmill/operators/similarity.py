"""Exact similarity of candidate pairs of texts. A bitmap at the scan keeps only texts that have a candidate; each goes once to each group of
pairs that needs it, where it becomes a set of hashes. The other texts stay where they are, and none is copied for each pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import arrays as A
from lexmill.functions import bitmap
from lexmill.session import Stages, broadcast_if

#: Pairs that are verified together.
GROUP = 2000
#: Rows of ids and groups that may be broadcast; more are shuffled.
FEW = 200_000


def grouped(pairs: DataFrame, count: int, group: int | None = None) -> DataFrame:
    """g, l, r: the pairs with their group, of about ``group`` pairs. Pairs meet in a group where their left ends have the same least partner, so that a
    text with many partners goes to few groups; the pairs of a least partner that has too many are cut into blocks of both ends."""
    group = group or GROUP
    ends = F.explode(F.array("l", "r")).alias("id")
    home = pairs.select(F.col("l").alias("low"), ends).groupBy("id").agg(F.min("low").alias("home"))
    homed = pairs.select("l", "r").join(home.withColumnRenamed("id", "l"), "l")
    size = homed.groupBy("home").agg(F.ceil(F.sqrt(F.count("*") / group)).cast("int").alias("side"))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.col("side"))
    large = F.xxhash64("home", block("l"), block("r"))
    small = F.pmod(F.xxhash64("home"), F.lit(max(1, -(-count // group))))
    return homed.join(size, "home").select(F.when(F.col("side") > 1, large).otherwise(small).alias("g"), "l", "r")


def _kept(sent):
    """id, text where the key (second column) is one that the bitmap lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = pa.array(bitmap.passed(sent.value, batch.column(1).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(use), batch.column(2).take(use)], names=["id", "text"])

    return run


def _score(threshold: float, kernel: Callable[[list[str]], list[np.ndarray]]):
    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        least: dict = {}
        for i, t in zip(texts["id"].to_pylist(), texts["text"].to_pylist()):
            least[i] = min(t or "", least.get(i, t or ""))
        names, own, sets = list(least), list(least.values()), []
        for a, b in A.slices(own):
            sets += kernel(own[a:b])
        grams = dict(zip(names, sets))
        score = np.full(len(pairs), -1.0)
        for i, (x, y) in enumerate(zip(pairs["l"].to_pylist(), pairs["r"].to_pylist())):
            if x in grams and y in grams:
                a, b = grams[x], grams[y]
                if min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                    both = np.concatenate([a, b])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    score[i] = common / (len(both) - common) if len(both) else 1.0
        ok = pa.array(score >= threshold)
        return pa.table({"l": pairs["l"].filter(ok), "r": pairs["r"].filter(ok), "similarity": pa.array(score).filter(ok)})

    return run


def scored(pairs: DataFrame, texts: DataFrame, threshold: float, kernel: Callable[[list[str]], list[np.ndarray]]) -> DataFrame:
    """l, r, similarity of the pairs (l, r) at or above the threshold. ``texts`` has id and text, ``kernel`` gives each text's distinct
    hashes in order. Pairs without a text on both sides are left out; two empty sets are equal; of repeated ids the least text counts."""
    spark, stages = texts.sparkSession, Stages(texts.sparkSession)
    kind = texts.schema["id"].dataType.simpleString()
    pairs = stages.put(pairs.select("l", "r"))
    in_groups = stages.put(grouped(pairs, pairs.count()))
    needed = stages.put(in_groups.select("g", F.explode(F.array("l", "r")).alias("id")).distinct())
    keys = stages.put(needed.select(F.xxhash64("id").alias("key")).distinct())
    sent = spark.sparkContext.broadcast(bitmap.build(keys, keys.count()))
    met = texts.select("id", F.xxhash64("id").alias("key"), "text").mapInArrow(_kept(sent), f"id {kind}, text string")
    sent_to = broadcast_if(needed, needed.count(), FEW).join(met, "id").select("g", "id", "text")
    stages.drop(keys)
    return in_groups.groupBy("g").cogroup(sent_to.groupBy("g")).applyInArrow(_score(threshold, kernel), f"l {kind}, r {kind}, similarity double")
