"""A sample that is the same in every run and keeps its members as data grows (problem 7).

Consistent weighted Poisson sampling: a document is in the sample if the hash of its id, as a number in [0, 1),
is below weight x ``RATE``. The hash (``sampling_rank``) and the rate do not depend on other records; the weight
is the greatest token count the document ever had, so its inclusion probability never falls when a later
count is lower or missing. ``advance`` keeps these running maxima as a table that new records are merged into.

Defined results: rows without id are left out; null, zero and negative counts give weight 0 and no member;
null or foreign ranks in the input are not used; repeated rows change nothing; no rows give an empty sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inclusion probability of a document, for each of its tokens; fixed, so that it cannot change as data grow.
RATE = 1 / 5000
SEED = 2026


def rank(document_id: Column, seed: int = SEED) -> Column:
    """The sampling rank of a document: 64 hex digits that only its id and the seed decide."""
    return F.sha2(F.concat(F.lit(f"quota\0{seed}\0"), document_id), 256)


def weights(counts: DataFrame) -> DataFrame:
    """document_id, weight: the greatest count of each document in these rows."""
    return counts.where("document_id is not null").groupBy("document_id").agg(F.greatest(F.max("token_count"), F.lit(0)).alias("weight"))


def advance(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """Stored running maxima with those of new rows merged in."""
    return stored.select("document_id", "weight").unionByName(weights(counts)).groupBy("document_id").agg(F.max("weight").alias("weight"))


def sample(stored: DataFrame, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """document_id, sampling_rank, weight, inclusion: the sample of a table of running maxima."""
    ranked = stored.withColumn("sampling_rank", rank(F.col("document_id"), seed))
    # 52 bits of the rank are a double exactly
    number = F.conv(F.substring("sampling_rank", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    inclusion = F.least(F.lit(1.0), F.col("weight") * F.lit(rate))
    return ranked.withColumn("inclusion", inclusion).where(number < F.col("inclusion")).select("document_id", "sampling_rank", "weight", "inclusion")
