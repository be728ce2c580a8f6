"""Evaluation windows and the statistics that compare methods.

Score tables are long: method, seed, milestone, document_id, nll_sum, token_count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.draws import times
from lexmill.operators.running import hex_prefix, row_index
from lexmill.session import Stages, ship

#: Documents whose means may be broadcast for the bootstrap; more are joined.
FEW = 200_000
#: Draws of a task.
DRAWS = 10_000_000


def windows(docs: DataFrame, n: str = "token_count", context: int = 512, stride: int = 256) -> DataFrame:
    """document_id, window, start, end, first_target: every target from 1 to n - 1 once. Texts under two tokens have none."""
    last = F.ceil(F.greatest(F.col(n) - context, F.lit(0)) / stride).cast("int")
    end = F.least(F.col("window") * stride + context, F.col(n))
    before = F.when(F.col("window") == 0, 1).otherwise(F.least((F.col("window") - 1) * stride + context, F.col(n)))
    start = F.greatest(F.lit(0), end - context)
    rows = docs.where(F.col(n) >= 2).select("document_id", F.col(n), F.explode(F.sequence(F.lit(0), last)).alias("window"))
    return rows.select("document_id", "window", start.alias("start"), end.alias("end"), (before - start).alias("first_target"))


def length_windows(docs: DataFrame, n: str = "token_count", contexts=(512, 1024, 2048), anchor: int = 2048, targets: int = 256) -> DataFrame:
    """The same targets of each long document under several contexts."""
    rows = docs.where(F.col(n) >= anchor).select("document_id", F.explode(F.array(*map(F.lit, contexts))).alias("context"))
    return rows.select("document_id", "context", (anchor - F.col("context")).alias("start"), F.lit(anchor).alias("end"), (F.col("context") - targets).alias("first_target"))


def weighted_nll(scores: DataFrame, *by: str) -> DataFrame:
    """nll and ppl of each slice, weighted by tokens."""
    return scores.groupBy(*by).agg(F.sum("nll_sum").alias("s"), F.sum("token_count").alias("tokens")).select(*by, "tokens", (F.col("s") / F.col("tokens")).alias("nll"), F.exp(F.col("s") / F.col("tokens")).alias("ppl"))


def seed_summary(by_seed: DataFrame, *by: str) -> DataFrame:
    """Mean and sample deviation over seeds, exp of the mean and mean of exp."""
    return by_seed.groupBy(*by).agg(F.count("*").alias("seeds"), F.avg("nll").alias("mean_nll"), F.stddev_samp("nll").alias("sd_nll"), F.exp(F.avg("nll")).alias("ppl_of_mean"), F.avg(F.exp("nll")).alias("mean_ppl"))


def average_rank(value: str, *by: str) -> Column:
    """Rank from the least, ties sharing the mean of their ranks."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def holm(p: str, order: str, *by: str) -> Column:
    """Step-down adjusted p; of equal values the one that comes first in ``order`` is first."""
    w = Window.partitionBy(*by).orderBy(p, order)
    step = (F.count("*").over(Window.partitionBy(*by)) - F.row_number().over(w) + 1) * F.col(p)
    return step


def holm_adjusted(tests: DataFrame, p: str, order: str) -> DataFrame:
    """tests with p_holm; for the few tests of one analysis."""
    one = F.lit(0)
    stepped = tests.withColumn("_one", one).withColumn("_s", holm(p, order, "_one"))
    running = F.max("_s").over(Window.partitionBy("_one").orderBy(p, order).rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), running)).drop("_s", "_one")


def learning(summary: DataFrame, first: str) -> DataFrame:
    """summary (method, milestone, actual_tokens, mean_nll) with ranks, reduction against the first milestone, and whether it is lowest."""
    start = F.first("mean_nll").over(Window.partitionBy("method").orderBy("actual_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = summary.withColumn("descriptive_rank", average_rank("mean_nll", "milestone")).withColumn("nll_reduction", start - F.col("mean_nll"))
    return ranked.withColumn("lowest", F.rank().over(Window.partitionBy("milestone").orderBy("mean_nll")) == 1).withColumn("ppl", F.exp("mean_nll"))


def draws(scores: DataFrame, resamples: int, seed: int = 5, few: int = FEW) -> DataFrame:
    """Paired bootstrap over documents: replicate, method, nll. Seeds are averaged first (they share the denominators);
    every method has the same draws. Replicate r draws document number digest(seed, r, position) mod n, as often as there are
    documents: a pure function of its arguments, so that batches, partitions and engines agree. Up to ``few`` documents, their
    means are broadcast and a replicate is made where it is dealt to; beyond, draws are joined with the means."""
    spark = scores.sparkSession
    stages = Stages(spark)
    means = stages.put(scores.groupBy("method", "document_id").agg(F.avg("nll_sum").alias("m"), F.max("token_count").alias("n")))
    numbered = stages.put(row_index(means.select("document_id").distinct(), [], ["document_id"], "d", hex_prefix("document_id")))
    total = numbered.count()
    if 0 < total <= few:
        return stages.put(_drawn_here(means.join(numbered, "document_id"), total, resamples, seed))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "replicate", "position")), 1, 12), 16, 10).cast("bigint")
    # one row for each draw: positions are dealt out, so that a replicate is not one task's work
    picks = spark.range(resamples * total).select(F.floor(F.col("id") / max(total, 1)).alias("replicate"), (F.col("id") % max(total, 1)).alias("position"))
    drawn = picks.select("replicate", F.pmod(hashed, F.lit(max(total, 1))).alias("d")).groupBy("replicate", "d").agg(F.count("*").alias("times"))
    rows = drawn.join(numbered, "d").join(means, "document_id")
    return stages.put(rows.groupBy("replicate", "method").agg((F.sum(F.col("m") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("nll")))


def _drawn_here(means: DataFrame, total: int, resamples: int, seed: int) -> DataFrame:
    """replicate, method, nll from means (method, d, m, n) of ``total`` documents that fit a broadcast."""
    spark = means.sparkSession
    ship(spark)
    rows = means.select("method", "d", F.col("m").cast("double"), F.col("n").cast("double")).toArrow()
    methods = sorted(set(rows["method"].to_pylist()))
    sums = np.zeros((total, 2 * len(methods)))
    at, d = np.searchsorted(methods, rows["method"].to_pylist()), rows["d"].to_numpy()
    sums[d, at], sums[d, at + len(methods)] = (np.nan_to_num(rows[x].to_numpy()) for x in "mn")
    shared = spark.sparkContext.broadcast(sums)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for replicate in batch.column(0).to_pylist():
                m, n = np.split(times(seed, replicate, total) @ shared.value, 2)
                there = n > 0
                yield pa.RecordBatch.from_arrays([pa.array([replicate] * int(there.sum()), pa.int64()), pa.array([x for x, y in zip(methods, there) if y], pa.string()), pa.array(m[there] / n[there])], names=["replicate", "method", "nll"])

    parts = min(resamples, max(spark.sparkContext.defaultParallelism, resamples * total // DRAWS))
    return spark.range(0, resamples, 1, max(parts, 1)).mapInArrow(made, "replicate bigint, method string, nll double")


def compare(by_seed: DataFrame, drawn: DataFrame, practical: float = 0.01, consistent: int = 4) -> DataFrame:
    """Every pair of methods a < b: difference, interval, null-centred p and its adjustment, consistent seeds, effect flags."""
    means = by_seed.groupBy("method").agg(F.avg("nll").alias("nll"))
    pairs = means.toDF("a", "na").join(F.broadcast(means.toDF("b", "nb")), F.col("a") < F.col("b")).select("a", "b", (F.col("na") - F.col("nb")).alias("delta"))
    seeds = by_seed.select("seed", F.col("method").alias("a"), F.col("nll").alias("sa")).join(by_seed.select("seed", F.col("method").alias("b"), F.col("nll").alias("sb")), "seed").where("a < b")
    agree = seeds.join(pairs, ["a", "b"]).groupBy("a", "b").agg(F.count_if((F.signum(F.col("sa") - F.col("sb")) == F.signum("delta")) & (F.col("delta") != 0)).alias("consistent_seeds"))
    d = drawn.select("replicate", F.col("method").alias("a"), F.col("nll").alias("da")).join(drawn.select("replicate", F.col("method").alias("b"), F.col("nll").alias("db")), "replicate").where("a < b")
    d = d.join(pairs, ["a", "b"]).withColumn("x", F.col("da") - F.col("db"))
    stats = d.groupBy("a", "b").agg(
        F.first("delta").alias("delta"), F.percentile("x", F.lit(0.025)).alias("ci_low"), F.percentile("x", F.lit(0.975)).alias("ci_high"),
        ((1 + F.count_if(F.abs(F.col("x") - F.col("delta")) >= F.abs("delta"))) / (F.count("*") + 1)).alias("p"),
    )
    out = holm_adjusted(stats.join(agree, ["a", "b"]).withColumn("pair", F.concat_ws("/", "a", "b")), "p", "pair").drop("pair")
    supported = (F.col("p_holm") < 0.05) & ((F.col("ci_high") < 0) | (F.col("ci_low") > 0)) & (F.col("consistent_seeds") >= consistent)
    return out.select("*", (100 * F.expm1("delta")).alias("relative_ppl_percent"), (F.abs("delta") >= practical).alias("practical"), supported.alias("supported"))


def oriented(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The contrast of two methods as a - b, whichever way it is stored."""
    turn = F.col("a") != a
    found = rows.where(((F.col("a") == a) & (F.col("b") == b)) | ((F.col("a") == b) & (F.col("b") == a)))
    return found.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(turn, -F.col("delta")).otherwise(F.col("delta")).alias("delta"), F.when(turn, -F.col("ci_high")).otherwise(F.col("ci_low")).alias("ci_low"), F.when(turn, -F.col("ci_low")).otherwise(F.col("ci_high")).alias("ci_high"))
