"""Session helpers: settings, staged tables in the shared folder, table access."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build(cores: str = "8", app: str = "lexmill", partitions: int = 16) -> SparkSession:
    """A local session as the tests and the bench use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def _local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started: by its path, or, where executors
    are other machines, as an archive that Spark hands to them. Once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    known = sc.environment.get("PYTHONPATH", "")
    sc.environment["PYTHONPATH"] = os.pathsep.join([str(root), *([known] if known else [])])
    if not _local(spark):
        base = shared_dir(spark).removeprefix("file://")
        at = Path(base if "://" not in base else tempfile.mkdtemp()) / f"lexmill-{sc.applicationId}.zip"  # read on the driver only
        at.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted((root / "lexmill").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """A table of texts, for work that costs more than moving them: if its files give fewer tasks than there are
    cores, the rows are spread over all cores. Larger tables stay as they are read."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where that is unset, a folder of our own in a local session, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not _local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lexmill-"))
    return _own_dir[0]


_written: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


@atexit.register
def _clear() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    for path in list(_written):
        try:
            _remove(spark, path)
        except Exception:
            return


class Stages:
    """Tables written in the shared folder: they cut lineage and outlive the loss of executors.

    ``put`` writes a DataFrame and returns what reads it; ``drop`` deletes tables that a later one has replaced.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at: dict[int, str] = {}

    def put(self, df: DataFrame, files: int | None = None) -> DataFrame:
        path = f"{shared_dir(self.spark)}/lexmill-{uuid.uuid4().hex}"
        out = df if files is None else df.coalesce(files)
        _written.add(path)
        out.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(back)] = path
        return back

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            if df is not None and (path := self.at.pop(id(df), None)):
                _remove(self.spark, path)


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only if the counted rows are within the limit; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def hex64(c: Column) -> Column:
    """The 64 hex digits in a value, lower case, whatever stands around them; null if there are none."""
    found = F.regexp_extract(c, "[0-9a-fA-F]{64}", 0)
    return F.when(found != "", F.lower(found))
