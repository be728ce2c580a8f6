"""Cleaned records of the count and manifest tables: latest rows, one spelling of splits, sources and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import hex64

# The spellings of the three splits.
SPLITS = {"train": ["train", "training"], "validation": ["validation", "valid", "val", "dev"], "test": ["test"]}


def split_name(c: Column) -> Column:
    """train, validation or test, whatever the spelling; null if it is none of them."""
    name = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    for split, names in SPLITS.items():
        out = F.when(name.isin(names), split).otherwise(out)
    return out


def spelling(c: Column) -> Column:
    """A source or group name for comparison: lower case, one hyphen for blanks, underscores and hyphens, no outer blanks; empty is null."""
    name = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_-]+", "-")
    return F.when(name != "", name)


def latest(counts: DataFrame) -> DataFrame:
    """The row with the latest counted_at of each document, whole, nulls included; rows without id are left out.

    Between rows of one time the greater values hold, so the choice is the same in every run."""
    values = ["source", "source_group", "split", "token_count"]
    row = F.max(F.struct("counted_at", *values)).alias("r")
    return counts.where("document_id is not null").groupBy("document_id").agg(row).select("document_id", *[F.col(f"r.{v}").alias(v) for v in values], F.col("r.counted_at").alias("counted_at"))


def clusters(manifests: DataFrame) -> DataFrame:
    """document_id, cluster_id: each once, the id as 64 lower-case hex digits."""
    return manifests.select("document_id", hex64(F.col("duplicate_cluster_id")).alias("cluster_id")).where("document_id is not null and cluster_id is not null").distinct()


def clean_counts(counts: DataFrame, settings: DataFrame) -> DataFrame:
    """The latest count of each document with source, group and split in their one spelling; a null group is that of the source."""
    known = settings.select(spelling(F.col("source")).alias("key"), F.col("source").alias("name"), F.col("source_group").alias("by_source"))
    groups = settings.groupBy(spelling(F.col("source_group")).alias("gkey")).agg(F.min("source_group").alias("group_name"))
    rows = latest(counts).withColumns({"key": spelling(F.col("source")), "gkey": spelling(F.col("source_group")), "split": split_name(F.col("split"))})
    # the settings are a table of configuration
    rows = rows.join(F.broadcast(known), "key", "left").join(F.broadcast(groups), "gkey", "left")
    return rows.select("document_id", F.coalesce("name", "key").alias("source"), F.coalesce("group_name", "by_source").alias("source_group"), "split", "token_count")
