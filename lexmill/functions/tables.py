"""Schedules and positional tables as DataFrames made by arithmetic over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("learned", "sinusoidal", "rope", "alibi", "nope")
SEEDS = (17, 42, 1234, 2027, 31415)


def lr_schedule(spark: SparkSession, steps: int, peak: float = 6e-4, warm: float = 0.01, floor: float = 0.1, extra: int = 5) -> DataFrame:
    """step, lr: linear warm-up, cosine down to floor x peak, constant beyond the last step."""
    warmup, least = max(1, int(steps * warm)), peak * floor
    step = F.col("step")
    progress = (step - warmup) / F.lit(float(max(1, steps - warmup)))
    cosine = least + (peak - least) * (0.5 * (1 + F.cos(F.pi() * progress)))
    lr = F.when(step < warmup, peak * (step + 1) / warmup).when(step >= steps, F.lit(least)).otherwise(cosine)
    return spark.range(steps + extra).select(F.col("id").alias("step")).select("step", lr.alias("lr"))


def milestones(spark: SparkSession, total: int = 50_000_000, batch: int = 65_536, nominal=(5_000_000, 10_000_000, 20_000_000, 50_000_000)) -> DataFrame:
    """nominal_tokens, actual_tokens, overshoot, is_final; two milestones on one boundary are an error."""
    n = F.col("nominal_tokens")
    ceiling = F.when(n == total, F.lit(total)).otherwise(F.least(F.ceil(n / batch) * batch, F.lit(total))).cast("bigint")
    df = spark.createDataFrame([(x,) for x in nominal], "nominal_tokens bigint").withColumn("actual_tokens", ceiling)
    twice = df.groupBy("actual_tokens").agg(F.count("*").alias("same"))
    checked = df.join(F.broadcast(twice), "actual_tokens")  # a handful of rows
    wrong = (F.col("same") > 1) | (n <= 0) | (n > total)
    return checked.select("nominal_tokens", F.when(wrong, F.raise_error(F.lit("bad milestone")).cast("bigint")).otherwise(F.col("actual_tokens")).alias("actual_tokens"), (F.col("actual_tokens") - n).alias("overshoot"), (F.col("actual_tokens") == total).alias("is_final"))


def sinusoidal(spark: SparkSession, length: int, width: int, theta: float = 10000.0) -> DataFrame:
    pos = spark.range(length).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width // 2 - 1).cast("bigint"))).alias("pair"))
    angle = F.col("pos") * F.exp(F.lit(-1.0) * F.ln(F.lit(theta)) * (F.col("pair") * 2) / width)
    both = pos.withColumn("angle", angle)
    return both.select("pos", F.explode(F.array(F.struct((F.col("pair") * 2).alias("dim"), F.sin("angle").alias("value")), F.struct((F.col("pair") * 2 + 1).alias("dim"), F.cos("angle").alias("value")))).alias("x")).select("pos", "x.*")


def alibi_slope(head: Column, heads: int) -> Column:
    """Geometric slopes for a power of two of heads; for others those of the power below, then every second of the power above."""
    below = 1 << (heads.bit_length() - 1)
    own = F.pow(F.lit(2.0), F.lit(-8.0) * (head + 1) / below)
    return F.when(head < below, own).otherwise(F.pow(F.lit(2.0), F.lit(-8.0) * (2 * (head - below) + 1) / (2 * below)))


def alibi(spark: SparkSession, heads: int, length: int) -> DataFrame:
    h = spark.range(heads).select(F.col("id").alias("head"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(length - 1).cast("bigint"))).alias("distance"))
    return h.select("head", "distance", alibi_slope(F.col("head"), heads).alias("slope")).withColumn("bias", F.lit(0.0) - F.col("slope") * F.col("distance"))


def run_matrix(spark: SparkSession) -> DataFrame:
    runs = spark.createDataFrame([(m, s) for m in METHODS for s in SEEDS], "method string, seed int")
    return runs.select("method", "seed", F.format_string("run-%s-s%d-t50m-c512-v16k", "method", "seed").alias("run_id"))


def benchmark_candidates(spark: SparkSession, batch: int = 65_536, length: int = 512, most: int = 256) -> DataFrame:
    """micro_batch, accumulation: micro-batches that divide the global batch."""
    m = spark.range(1, most + 1).select(F.col("id").alias("micro_batch"))
    return m.where(F.lit(batch) % (F.col("micro_batch") * length) == 0).select("micro_batch", (F.lit(batch) / (F.col("micro_batch") * length)).cast("bigint").alias("accumulation"))
