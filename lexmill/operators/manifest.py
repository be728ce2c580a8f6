"""Splits, manifests and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import ids, text
from lexmill.operators.running import hex_prefix, row_index
from lexmill.session import hex64


def processed(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Documents without removed near copies, with their cluster (their own id if none) and the split of that cluster."""
    m = members.select(F.col("rowid").alias("row_index"), "cluster_id", "removed")
    df = docs.join(m, "row_index", "left").where(F.coalesce("removed", F.lit(0)) == 0)
    df = df.withColumn("duplicate_cluster_id", F.coalesce("cluster_id", "document_id")).drop("cluster_id", "removed")
    return df.withColumn("split", ids.split_of(ids.split_bucket(F.col("duplicate_cluster_id"))))


def manifest(kept: DataFrame) -> DataFrame:
    """The manifest columns with each document's position in its split, in document_id order."""
    slim = kept.select("document_id", "source", "source_group", "duplicate_cluster_id", F.col("canonical_hash").alias("canonical_text_hash"), "split", "raw_record_id", F.col("shard").alias("raw_shard"), F.col("row_index").alias("raw_row_index"))
    return row_index(slim, ["split"], ["document_id"], "processed_row", hex_prefix("document_id"))


def summary(kept: DataFrame) -> DataFrame:
    """documents, characters, words by split and source, by split, and in all ('*' is all)."""
    rows = kept.select("split", "source", F.length("text").alias("c"), text.word_count(F.col("text")).alias("w"))
    sums = rows.rollup("split", "source").agg(F.count("*").alias("documents"), F.sum("c").alias("characters"), F.sum("w").alias("words"), F.grouping_id().alias("g"))
    return sums.select(F.when(F.col("g") == 3, "*").otherwise(F.col("split")).alias("split"), F.when(F.col("g") >= 1, "*").otherwise(F.col("source")).alias("source"), "documents", "characters", "words")


def shared_between_splits(manifests: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, splits: values of the columns that stand in more than one split. The 64 hex digits of a value are compared, in whatever case and
    whatever stands around them; a value without such digits is compared as it is."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(hex64(F.col(c)), F.col(c)).alias("value")) for c in columns])).alias("x")
    per = manifests.select("split", values).select("split", "x.*").where("value is not null").groupBy("field", "value").agg(F.array_sort(F.collect_set("split")).alias("s"))
    return per.where(F.size("s") > 1).select("field", "value", F.array_join("s", ",").alias("splits"))


def row_problems(manifests: DataFrame) -> DataFrame:
    """Of each file: rows, ids that are not 64 hex digits, positions that occur twice, the least and greatest position."""
    per = manifests.groupBy("processed_file", "processed_row").agg(F.count("*").alias("n"), F.count_if(~F.col("document_id").rlike("^[0-9a-f]{64}$")).alias("bad"))
    return per.groupBy("processed_file").agg(F.sum("n").alias("records"), F.sum("bad").alias("bad_ids"), F.count_if(F.col("n") > 1).alias("repeated_positions"), F.min("processed_row").alias("first_row"), F.max("processed_row").alias("last_row"))


def order_problems(rows: DataFrame, group: str, position: str, identifier: str) -> DataFrame:
    """group, rows, gaps, disorder: positions that do not follow the one before, and identifiers not above the one before.
    Compared with the row at the next position by a join, so a group is not held by one task."""
    slim = rows.select(group, position, identifier).distinct()
    nxt = slim.select(group, (F.col(position) - 1).alias(position), F.col(identifier).alias("_next"))
    last = slim.groupBy(group).agg(F.max(position).alias("_last"), F.count("*").alias("rows"))
    met = slim.join(nxt, [group, position], "left").join(F.broadcast(last), group)  # one row for each file or split
    return met.groupBy(group).agg(F.first("rows").alias("rows"), F.count_if((F.col(position) < F.col("_last")) & F.col("_next").isNull()).alias("gaps"), F.count_if(F.coalesce(F.col("_next") <= F.col(identifier), F.lit(False))).alias("disorder"))


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, field, left_value, right_value wherever two tables of the same records differ, or one lacks the record."""
    fields = [c for c in left.columns if c != key and c in right.columns]

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in fields])).alias("x")).select(key, "x.*", F.lit(True).alias(f"in_{name}"))

    both = long(left, "left_value").join(long(right, "right_value"), [key, "field"], "full")
    return both.where("not (left_value <=> right_value) or in_left_value is null or in_right_value is null").select(key, "field", "left_value", "right_value")


def safe_path(path):
    """Relative, without a step upwards."""
    return ~path.rlike(r"^([A-Za-z]:)?[/\\\\]") & ~path.rlike(r"(^|[/\\\\])\.\.([/\\\\]|$)")
