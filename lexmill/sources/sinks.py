"""Writing results: each goes to a staging path, is read back and counted, and only then takes its place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text


def _fs(df: DataFrame, path: str):
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _staged(df: DataFrame, path: str, rows: int | None, partition_by: tuple[str, ...]) -> tuple[str, int]:
    """Write parquet beside ``path`` and compare the row count with ``rows``; the staged folder and the count."""
    staging = f"{path.rstrip('/')}.partial-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(staging)
    got = df.sparkSession.read.parquet(staging).count()
    if rows is not None and got != rows:
        fs, staged = _fs(df, staging)
        fs.delete(staged, True)
        raise ValueError(f"{got} rows were written, {rows} expected")
    return staging, got


def _swap(df: DataFrame, staging: str, path: str) -> str | None:
    """Put the staged folder in place; what stood there is moved aside and named, until the caller deletes it."""
    fs, target = _fs(df, path)
    aside = None
    if fs.exists(target):
        aside = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
        if not fs.rename(target, _fs(df, aside)[1]):
            raise OSError(f"{path} could not be moved aside")
    if not fs.rename(_fs(df, staging)[1], target):
        if aside:
            fs.rename(_fs(df, aside)[1], target)
        raise OSError(f"{staging} could not take the place of {path}")
    return aside


def promote(df: DataFrame, path: str, rows: int | None = None, partition_by: tuple[str, ...] = (), stale: tuple[str, ...] = ()) -> int:
    """Write parquet beside ``path``, compare the row count with ``rows``, and swap it in. The old data stand aside until the new ones are
    in place, so a crash at any point leaves one of them whole. ``stale`` are files of the old data that go with them. Gives the count."""
    return promote_all([(df, path, rows, partition_by)], stale)[0]


def promote_all(tables: list[tuple[DataFrame, str, int | None, tuple[str, ...]]], stale: tuple[str, ...] = ()) -> list[int]:
    """The same for several tables that belong together: none is swapped in before all are written and counted."""
    staged = [(df, path, *_staged(df, path, rows, by)) for df, path, rows, by in tables]
    old = [(df, aside) for df, path, staging, _ in staged if (aside := _swap(df, staging, path))]
    for df, path in [*old, *((tables[0][0], x) for x in stale)]:
        fs, where = _fs(df, path)
        fs.delete(where, True)
    return [got for *_, got in staged]


def corpus(df: DataFrame, path: str, rows: int | None = None) -> int:
    """The processed corpus: a folder for each split, in document_id order inside files."""
    return promote(df.repartitionByRange("split", "document_id").sortWithinPartitions("split", "document_id"), path, rows, ("split",))


def manifests(df: DataFrame, path: str, rows: int | None = None) -> int:
    """The manifest of the corpus: a folder for each split, in the order of the positions."""
    return promote(df.repartitionByRange("split", "processed_row").sortWithinPartitions("split", "processed_row"), path, rows, ("split",))


def corpus_and_manifests(docs: DataFrame, manifest: DataFrame, path: str, manifest_path: str) -> tuple[int, int]:
    """Both, swapped in together; they must have equally many rows."""
    n = manifest.count()
    by_id = docs.repartitionByRange("split", "document_id").sortWithinPartitions("split", "document_id")
    by_row = manifest.repartitionByRange("split", "processed_row").sortWithinPartitions("split", "processed_row")
    return tuple(promote_all([(by_id, path, n, ("split",)), (by_row, manifest_path, n, ("split",))]))


def cache(blocks: DataFrame, path: str) -> dict[str, int]:
    """Blocks of token ids (block, ids) in order, and their metadata. Ids beyond 16 bits are an error before anything takes its place."""
    bad = F.when(F.coalesce(F.array_max("ids"), F.lit(0)) > 65_535, F.raise_error(F.lit("an id needs more than 16 bits")).cast("array<int>")).otherwise(F.col("ids"))
    n = promote(blocks.select("block", bad.alias("ids")).repartitionByRange("block").sortWithinPartitions("block"), path)
    tokens = blocks.sparkSession.read.parquet(path).agg(F.sum(F.size("ids"))).first()[0] or 0
    return {"blocks": n, "tokens": tokens, "bytes": 2 * tokens}


def lines(df: DataFrame, path: str, column: str = "text") -> None:
    """One text a line; anything but training records is an error."""
    bad = F.when(F.col("split") != "train", F.raise_error(F.lit("only training records may be written"))).otherwise(text.one_line(F.col(column)))
    df.select(bad.alias("value")).write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str, *order: str) -> None:
    """A table of results with its header; an empty one is an error."""
    if df.isEmpty():
        raise ValueError(f"there are no rows for {path}")
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True)


def events(df: DataFrame, path: str) -> None:
    """Append to a log of JSON lines."""
    df.withColumn("time", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def report(df: DataFrame, path: str) -> None:
    """A nested report as JSON lines with sorted keys."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)
