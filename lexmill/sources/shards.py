"""Reading shards, and checking their files.

Defined results: a pattern without files is an error of the reader; a missing text column or one that is no string is an error before any row is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import ship

#: Bytes of a file that are read at once.
CHUNK = 8 << 20


def check_text(df: DataFrame, column: str) -> DataFrame:
    kinds = dict(df.dtypes)
    if column not in kinds:
        raise ValueError(f"there is no column {column}")
    if kinds[column] != "string":
        raise TypeError(f"{column} is {kinds[column]}, not string")
    return df


def scan(spark: SparkSession, path: str, source: str, column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """source, shard, row_index, text of one source's parquet shards, and the columns to ``keep``; the row index begins anew in each shard."""
    df = check_text(spark.read.parquet(path), column)
    return df.select(*keep, F.lit(source).alias("source"), F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row_index"), F.col(column).alias("text"))


def scan_all(spark: SparkSession, root: str, sources: list[str], column: str = "text") -> DataFrame:
    """All included sources in their configured order, as one scan each."""
    out = None
    for order, source in enumerate(sources):
        part = scan(spark, f"{root}/{source}/*.parquet", source, column).withColumn("source_order", F.lit(order))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source is included")
    return out


def _relative(uri: str, root: str) -> str:
    """A file's path below ``root`` (up to its first wildcard), or its name if it is elsewhere."""
    at = unquote(urlparse(uri).path)
    base = re.split(r"[*?\[{]", unquote(urlparse(root).path))[0].rstrip("/")
    base = base if at.startswith(base + "/") else base.rpartition("/")[0]
    return at[len(base) + 1 :] if base and at.startswith(base + "/") else at.rpartition("/")[2]


FILES = "path string, file string, bytes bigint, sha256 string"
FOOTERS = "path string, file string, bytes bigint, sha256 string, records bigint, row_groups int, null_texts bigint, schema array<struct<name:string,type:string>>"


def _listed(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length: the files, not read; dealt out one by one."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length")
    return rows.repartition(max(1, min(10_000, rows.count())), "path")


def _open(uri: str):
    system, at = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return system.open_input_file(at)


def _digest(stream) -> str:
    """SHA-256 of a stream, read in pieces, so that a file of any size does."""
    out = hashlib.sha256()
    while piece := stream.read(CHUNK):
        out.update(piece)
    return out.hexdigest()


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, file (below the path), bytes, sha256 of every file under a path; contents are hashed where they are read, piece by piece."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, size in zip(batch.path, batch.length):
                with _open(uri) as stream:
                    yield pd.DataFrame([(uri, _relative(uri, path), size, _digest(stream))], columns=["path", "file", "bytes", "sha256"])

    return _listed(spark, path).mapInPandas(run, FILES)


def footers(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """path, file, bytes, sha256, records, row_groups, null_texts, schema of every parquet file, from its footer; null_texts is null where a row group has no statistics."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, size in zip(batch.path, batch.length):
                with _open(uri) as stream:
                    digest = _digest(stream)
                    stream.seek(0)
                    meta = pq.ParquetFile(stream).metadata
                    schema = meta.schema.to_arrow_schema()
                    nulls: int | None = 0
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        own = next((c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == column), None)
                        known = own is not None and own.statistics is not None and own.statistics.has_null_count
                        nulls = nulls + own.statistics.null_count if known and nulls is not None else None
                    row = (uri, _relative(uri, path), size, digest, meta.num_rows, meta.num_row_groups, nulls, [{"name": f.name, "type": str(f.type)} for f in schema])
                    yield pd.DataFrame([row], columns=[c.split()[0] for c in FOOTERS.split(", ")]).astype({"null_texts": "Int64"})

    return _listed(spark, path, "*.parquet").mapInPandas(run, FOOTERS)


def inventory(spark: SparkSession, path: str, source: str, column: str = "text") -> DataFrame:
    """source, file, bytes, sha256, records, row_groups, null_texts, schema of each shard of a source; a missing or other text column is an error."""
    check_text(spark.read.parquet(path), column)
    return footers(spark, path, column).select(F.lit(source).alias("source"), "file", "bytes", "sha256", "records", "row_groups", "null_texts", "schema")


def totals(inventories: DataFrame) -> DataFrame:
    """One row: files, records, bytes and a hash of the whole inventory (of the digests of 4096 ranges of its lines, so that no task holds all lines)."""
    line = F.concat_ws("\0", "source", "file", "sha256")
    ranges = inventories.select("records", "bytes", line.alias("line")).groupBy(F.substring(F.sha2("line", 256), 1, 3).alias("p"))
    per = ranges.agg(F.count("*").alias("n"), F.sum("records").alias("r"), F.sum("bytes").alias("b"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x.h), "\n"), 256)
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.sum("r").alias("records"), F.sum("b").alias("bytes"), whole.alias("inventory_hash"))


def registry(inventories: DataFrame) -> DataFrame:
    """source, shards: the files of each source as structs, in file order."""
    return inventories.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("file", "records", "bytes", "sha256"))).alias("shards"))


def unchanged(stored: DataFrame, now: DataFrame) -> DataFrame:
    """source, file, status of every stored file: ok, missing, size or hash. Files are known by source and path below it, so equal names in two sources stay apart."""
    other = now.select("source", "file", F.col("bytes").alias("b"), F.col("sha256").alias("h"))
    status = F.when(F.col("h").isNull(), "missing").when(F.col("b") != F.col("bytes"), "size").when(F.col("h") != F.col("sha256"), "hash").otherwise("ok")
    return stored.join(other, ["source", "file"], "left").select("source", "file", status.alias("status"))


def discovered(spark: SparkSession, path: str) -> DataFrame:
    """kind, files, bytes: what stands under a path, by the ending of the names."""
    kind = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return _listed(spark, path).groupBy(F.when(kind != "", F.lower(kind)).otherwise("none").alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def junit(spark: SparkSession, path: str) -> DataFrame:
    """tests, failures, errors, seconds of test suites in XML."""
    df = spark.read.format("xml").option("rowTag", "testsuite").load(path)
    return df.agg(F.sum("_tests").alias("tests"), F.sum("_failures").alias("failures"), F.sum("_errors").alias("errors"), F.sum("_time").alias("seconds"))


def table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)
