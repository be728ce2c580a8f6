"""Profiles of raw texts: counters, flags, exact quantiles, stable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import ids, text

LEVELS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def source_profile(raw: DataFrame) -> DataFrame:
    """documents, null, empty, whitespace-only texts, characters, words, letters of each source; nulls count nowhere else."""
    t = F.col("text")
    sums = {"characters": F.length(t), "words": text.word_count(t), "letters": text.letters(t), "latin_letters": text.latin_letters(t)}
    blank = F.regexp_replace(t, f"[{text.SPACE}]+", "") == ""
    return raw.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if(t.isNull()).alias("null_documents"),
        F.count_if(F.coalesce(t == "", F.lit(False))).alias("empty_documents"),
        F.count_if(F.coalesce((t != "") & blank, F.lit(False))).alias("whitespace_only_documents"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()],
    )


def flag_histogram(rows: DataFrame) -> DataFrame:
    return rows.select("source", F.explode(text.quality_flags(F.col("text"))).alias("flag")).groupBy("source", "flag").agg(F.count("*").alias("documents"))


def nearest_rank(rows: DataFrame, group: str, value: Column, levels=LEVELS) -> DataFrame:
    """group, level, value: the least value at which max(1, int(n p + 0.999999)) rows are reached. Counted from a histogram of
    values, which is as long as there are different values, not rows."""
    hist = rows.select(F.col(group), value.alias("v")).where("v is not null").groupBy(group, "v").agg(F.count("*").alias("n"))
    return nearest_rank_counts(hist, group, "v", "n", levels)


def nearest_rank_counts(counts: DataFrame, group: str, value: str, count: str, levels=LEVELS) -> DataFrame:
    """The same of a table of values and how often each stands; values may repeat."""
    hist = counts.groupBy(F.col(group), F.col(value).alias("v")).agg(F.sum(count).alias("n"))
    upto = Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    cum = hist.select(group, "v", F.sum("n").over(upto).alias("c"), F.sum("n").over(whole).alias("total"))
    levels_ = F.explode(F.array(*[F.lit(float(p)) for p in levels])).alias("level")
    want = F.greatest(F.lit(1), F.floor(F.col("total") * F.col("level") + 0.999999))
    return cum.select(group, "v", "c", "total", levels_).where(F.col("c") >= want).groupBy(group, "level").agg(F.min("v").alias("value"))


def stable_sample(raw: DataFrame, k: int) -> DataFrame:
    """The k records of each source with the least 64-bit rank; of equal ranks the greater id. Each task keeps its own k first."""
    rid = ids.raw_record_id(F.col("source"), F.col("shard"), F.col("row_index"))
    rows = raw.select("source", rid.alias("raw_record_id")).withColumn("rank", ids.stable_int(F.lit(str(ids.SEED)), F.col("raw_record_id")))
    w = Window.partitionBy("source").orderBy("rank", F.desc("raw_record_id"))
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def flag_examples(raw: DataFrame, k: int = 5) -> DataFrame:
    """The first k records of each source and flag, with an excerpt."""
    rows = raw.select("source", "shard", "row_index", F.explode(text.quality_flags(F.col("text"))).alias("flag"), text.excerpt(F.col("text")).alias("excerpt"))
    w = Window.partitionBy("source", "flag").orderBy("shard", "row_index")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def longest_words(docs: DataFrame, at_least: int = 12, k: int = 20) -> DataFrame:
    """The k longest different words (case aside), in the spelling of their first occurrence."""
    found = docs.select("document_id", F.posexplode(F.regexp_extract_all("text", F.lit(text.WORD), F.lit(0))).alias("position", "word"))
    long = found.where(F.length("word") >= at_least).withColumn("folded", F.lower("word"))
    first = long.groupBy("folded").agg(F.min_by("word", F.struct("document_id", "position")).alias("word"))
    return first.select("word", F.length("word").alias("length")).orderBy(F.desc("length"), F.desc("word")).limit(k)
