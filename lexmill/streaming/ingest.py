"""New shards as a stream (beyond the batch stages): the same normalization and identities, copies dropped as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import ingest


def read(spark: SparkSession, path: str, schema: str, files_at_once: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def documents(stream: DataFrame, settings: DataFrame, time: str = "crawled_at", late: str = "7 days") -> DataFrame:
    """Kept documents, each text once while its hash is remembered: state is dropped behind the watermark."""
    known = settings.where("included_in_core").select("source", "source_group", "source_order")
    rows = stream.select(ingest.text.source_key(F.col("source")).alias("source"), F.lit("stream").alias("shard"), F.col("doc_id").alias("row_index"), "text", time)
    kept = ingest.retained(ingest.normalize(rows.join(F.broadcast(known), "source")))
    return kept.withWatermark(time, late).dropDuplicatesWithinWatermark(["canonical_hash"])


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accounting(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counters of each batch and source, appended once for each batch (a repeated batch replaces its own)."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("source").agg(F.count("*").alias("documents"), F.sum("letter_count").alias("letters")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
