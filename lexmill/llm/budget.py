"""Token budget by source, language, domain and split (problem 5).

Whole texts are hashed; of equal texts the one with the least id is tokenized, and the count goes back to every
document with that hash. Only hashes and ids are shuffled, never texts.

Defined results: null and empty texts have 0 tokens and are documents all the same; rows without id are left out; repeated
rows of an id count once; null sources, languages and domains are slices of their own; a document without a latest
row in token_counts has a null split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.tokens import counted
from lexmill.functions import bitmap
from lexmill.llm.langid import language_of
from lexmill.operators.records import latest, spelling, split_name
from lexmill.session import Stages, broadcast_if

#: Ids that may be broadcast.
SMALL = 200_000


def _passing(sent, wanted: bool):
    """The rows whose key (second column) the bitmap lets pass, or does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.full(batch.num_rows, not wanted)
            keep[bitmap.passed(sent.value, batch.column(1).to_numpy().view(np.uint64))] = wanted
            yield batch.filter(pa.array(keep))

    return run


def document_tokens(docs: DataFrame, counter, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """id, tokens for every document; each distinct text is tokenized once."""
    stages = Stages(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = stages.put(texts.select("id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key")).distinct())
    first = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    copies = stages.put(keyed.join(first.where("n > 1"), "key").where("id <> rep").select("id", "rep"))
    number = copies.count()
    if number <= small:
        own = counted(texts.join(F.broadcast(copies.select("id")), "id", "left_anti"), "id", "text", counter)
    else:
        # texts stay where they are: rows that a bitmap of the copies stops are no copies, and of those it lets pass the few that are none are read again
        flags = docs.sparkSession.sparkContext.broadcast(bitmap.build(copies.select(F.xxhash64("id").alias("key")), number))
        kind = texts.schema["id"].dataType.simpleString()
        passed = keyed.select("id", F.xxhash64("id").alias("key")).mapInArrow(_passing(flags, True), f"id {kind}, key bigint").select("id")
        rest = stages.put(passed.join(copies.select("id"), "id", "left_anti"))
        again = texts.join(broadcast_if(rest, rest.count(), small), "id", "left_semi")
        plain = texts.select("id", F.xxhash64("id").alias("key"), "text").mapInArrow(_passing(flags, False), f"id {kind}, key bigint, text string")
        own = counted(plain, "id", "text", counter).unionByName(counted(again, "id", "text", counter))
    own = stages.put(own)
    shared = copies.join(own.withColumnRenamed("id", "rep"), "rep").select("id", "tokens")
    return own.unionByName(shared).groupBy("id").agg(F.max("tokens").alias("tokens"))


def budget(docs: DataFrame, counter, counts: DataFrame) -> DataFrame:
    """source, lang, domain, split, documents, tokens, token_count (with one end mark a document): totals of each slice, and by grouping level the totals of
    each source, language, domain and split alone and of all (columns not in the level are '*')."""
    tokens = document_tokens(docs, counter)
    own = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.min("document_id").alias("document_id"), F.min(spelling(F.col("source"))).alias("source"), F.min(language_of(F.col("lang"))).alias("lang"), F.min(F.lower(F.trim("domain"))).alias("domain")
    )
    split = latest(counts).select("document_id", split_name(F.col("split")).alias("split"))
    rows = own.join(tokens, "id").join(split, "document_id", "left").select("source", "lang", "domain", "split", "tokens")
    fine = rows.groupBy("source", "lang", "domain", "split").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    fine = Stages(docs.sparkSession).put(fine)
    names = ["source", "lang", "domain", "split"]
    levels = [names, *[[n] for n in names], []]
    out = None
    for level in levels:
        part = fine.groupBy(*level).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        part = part.select(*[F.col(n) if n in level else F.lit("*").alias(n) for n in names], "documents", "tokens").where("documents is not null")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("token_count", F.col("tokens") + F.col("documents"))
