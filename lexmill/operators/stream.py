"""Token ids end to end: documents of ids placed in one stream, the stream's blocks and batches with labels, and evaluation windows.

A document's ids never travel whole with each block or window it has: they are cut where they stand, and the pieces travel.

Defined results: documents without ids take no place; no documents give no rows; the last block and batch may be short, which labels of IGNORED show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import ids as names
from lexmill.operators.running import hex_prefix, row_index, running_sum

# The end mark, the label that counts for nothing, targets of a block and of a batch.
END, IGNORED, LENGTH, BATCH = 1, -100, 512, 65_536


def hashed(ids: str | Column) -> Column:
    """A digest of an array of ids, to compare long arrays by."""
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))


def bounds(encoded: DataFrame, size: int) -> DataFrame:
    """document_id, tokens, least, greatest, in_bounds: whether all ids are of a vocabulary of ``size`` and fit 16 bits."""
    least, greatest = F.array_min("ids"), F.array_max("ids")
    good = (least >= 0) & (greatest < min(size, 1 << 16))
    return encoded.select("document_id", F.size("ids").alias("tokens"), least.alias("least"), greatest.alias("greatest"), F.coalesce(good, F.lit(False)).alias("in_bounds"))


def placed(encoded: DataFrame, seed: int = names.SEED) -> DataFrame:
    """document_id, ids, tokens, sampling_order, stream_offset: documents in the order of their rank, one after the other."""
    rows = encoded.select("document_id", "ids", F.size("ids").cast("bigint").alias("tokens")).where("tokens > 0")
    slim = rows.select("document_id", "tokens", names.sampling_rank("order", F.col("document_id"), seed).alias("rank"))
    slim = row_index(slim, [], ["rank", "document_id"], "sampling_order", hex_prefix("rank"))
    slim = running_sum(slim, [], ["rank", "document_id"], F.col("tokens"), "stream_offset", hex_prefix("rank"))
    return rows.select("document_id", "ids").join(slim.drop("rank"), "document_id")


def truncated(stream: DataFrame, target: int) -> DataFrame:
    """The stream up to ``target`` tokens; the document at the boundary is cut, with or without its end mark."""
    room = F.lit(target) - F.col("stream_offset")
    rows = stream.where(room > 0)
    return rows.withColumn("ids", F.when(F.col("tokens") <= room, F.col("ids")).otherwise(F.slice("ids", F.lit(1), room.cast("int")))).withColumn("tokens", F.least("tokens", room))


def blocks(stream: DataFrame, length: int = LENGTH) -> DataFrame:
    """block, documents, ids: the contents of the blocks of the stream, in order; the tail is the last, shorter one."""
    end = F.col("stream_offset") + F.col("tokens")
    numbers = F.sequence(F.floor(F.col("stream_offset") / length), F.floor((end - 1) / length))

    def piece(block: Column) -> Column:
        first, last = F.greatest(block * length, F.col("stream_offset")), F.least((block + 1) * length, end)
        own = F.slice("ids", (first - F.col("stream_offset") + 1).cast("int"), (last - first).cast("int"))
        return F.struct(block.alias("block"), first.alias("at"), own.alias("ids"))

    pieces = stream.select(F.explode(F.transform(numbers, piece)).alias("x")).select("x.*")
    parts = F.array_sort(F.collect_list(F.struct("at", "ids")))  # at most ``length`` ids
    return pieces.groupBy("block").agg(F.count("*").alias("documents"), parts.alias("parts")).select("block", "documents", F.flatten("parts.ids").alias("ids"))


def batches(in_blocks: DataFrame, rows: int = BATCH // LENGTH, length: int = LENGTH) -> DataFrame:
    """batch, row, input_ids, labels, real_tokens, end_offset: rectangular batches; what the stream lacks is end marks with labels of IGNORED.

    ``end_offset`` is the cursor after the batch."""
    last = in_blocks.agg(F.max("block").alias("last"), F.sum(F.size("ids")).alias("total")).where("last is not null")
    filler = last.select(F.explode(F.sequence(F.lit(0), F.pmod(-F.col("last") - 1, F.lit(rows)))).alias("k"), "last").where("k > 0")
    filler = filler.select((F.col("last") + F.col("k")).alias("block"), F.array().cast("array<int>").alias("ids"))
    lack = lambda value: F.array_repeat(F.lit(value), F.lit(length) - F.size("ids"))
    full = in_blocks.select("block", "ids").unionByName(filler).join(F.broadcast(last.select("total")))  # one row
    size = rows * length
    batch = F.floor(F.col("block") / rows)
    return full.select(
        batch.alias("batch"), (F.col("block") % rows).alias("row"), F.concat("ids", lack(END)).alias("input_ids"), F.concat("ids", lack(IGNORED)).alias("labels"),
        F.size("ids").alias("real_tokens"), F.least((batch + 1) * size, F.col("total")).alias("end_offset"),
    )


def positions(stream: DataFrame, target: int, files: DataFrame) -> DataFrame:
    """document_id, processed_file, processed_row, stream_offset, tokens, stored_tokens, problem: the plan joined with the stored rows (document_id, processed_file,
    processed_row, token_count) by their position, with what is wrong: missing, or another number of tokens than was stored; null if nothing is."""
    stored = files.select("processed_file", "processed_row", F.col("document_id").alias("stored_id"), F.col("token_count").alias("stored_tokens"))
    met = truncated(stream, target).drop("ids").join(stored, ["processed_file", "processed_row"], "left")
    problem = F.when(F.col("stored_id").isNull(), "missing").when(F.col("stored_id") != F.col("document_id"), "identity").when(F.col("stored_tokens") < F.col("tokens"), "tokens")
    return met.select("document_id", "processed_file", "processed_row", "stream_offset", "tokens", "stored_tokens", problem.alias("problem"))


def zipped(corpus: DataFrame, manifest: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """by, side, field: where two tables that must agree row for row (by position) do not: a row that one lacks (side, no field), or fields that differ."""
    both = corpus.select(*by, F.struct(*fields).alias("a")).join(manifest.select(*by, F.struct(*fields).alias("b")), by, "full")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    side = F.when(F.col("a").isNull(), "manifest only").when(F.col("b").isNull(), "corpus only").otherwise("both")
    rows = both.select(*by, side.alias("side"), F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(F.lit(None).cast("string"))).otherwise(differing).alias("f"))
    return rows.select(*by, "side", F.explode("f").alias("field"))


def window_ids(encoded: DataFrame, context: int = LENGTH, stride: int = 256) -> DataFrame:
    """document_id, window, input_ids, labels, targets, bucket: the ids of each evaluation window; labels are IGNORED where a target was
    counted in a window before. ``bucket`` is the length in units of 64, by which windows are put together."""
    n = F.size("ids")
    last = F.ceil(F.greatest(n - context, F.lit(0)) / stride).cast("int")

    def window(k: Column) -> Column:
        end = F.least(k * stride + context, n)
        start = F.greatest(end - context, F.lit(0))
        before = F.when(k == 0, 1).otherwise(F.least((k - 1) * stride + context, n))
        own = F.slice("ids", start + 1, end - start)
        labels = F.concat(F.array_repeat(F.lit(IGNORED), before - start), F.slice("ids", before + 1, end - before))
        return F.struct(k.alias("window"), own.alias("input_ids"), labels.alias("labels"), (end - before).alias("targets"), F.ceil((end - start) / 64).cast("int").alias("bucket"))

    return encoded.where(n >= 2).select("document_id", F.explode(F.transform(F.sequence(F.lit(0), last), window)).alias("x")).select("document_id", "x.*")


def target_identity(encoded: DataFrame, windows: DataFrame) -> DataFrame:
    """document_id, expected, counted, holds: each target from 1 to n - 1 once."""
    counted = windows.groupBy("document_id").agg(F.sum("targets").alias("counted"))
    rows = encoded.where(F.size("ids") >= 2).select("document_id", (F.size("ids") - 1).cast("bigint").alias("expected")).join(counted, "document_id", "left")
    return rows.select("document_id", "expected", F.coalesce("counted", F.lit(0)).alias("counted"), F.col("expected").eqNullSafe(F.col("counted")).alias("holds"))


def cache_index(encoded: DataFrame) -> DataFrame:
    """split, document_id, processed_row, offset, tokens: where each document's ids begin in the array of its split, in document_id order."""
    rows = encoded.select("split", "document_id", F.size("ids").cast("bigint").alias("tokens"))
    rows = row_index(rows, ["split"], ["document_id"], "processed_row", hex_prefix("document_id"))
    return running_sum(rows, ["split"], ["document_id"], F.col("tokens"), "offset", hex_prefix("document_id"))


def cache_metadata(index: DataFrame, anchor: int = 2048) -> DataFrame:
    """split, documents, tokens_including_eod, primary_targets, length_documents, bytes (16 bits an id), full_blocks, tail."""
    total = F.sum("tokens")
    return index.groupBy("split").agg(
        F.count("*").alias("documents"), total.alias("tokens_including_eod"), (total - F.count("*")).alias("primary_targets"), F.count_if(F.col("tokens") >= anchor).alias("length_documents"),
        (total * 2).alias("bytes"), F.floor(total / LENGTH).alias("full_blocks"), (total % LENGTH).alias("tail"),
    )
