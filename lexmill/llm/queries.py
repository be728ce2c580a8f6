"""Queries of the llm operators, by name."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.tokens import ByteCounter, piece_counter
from lexmill.llm import budget, components, langid, leakage, mixing, neardup, overlap, packing, sampling, splits
from lexmill.session import table, texts

#: Where the public tokenizers' files are.
TOKENIZERS = os.environ.get("LEXMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def public_counter(folder: str = TOKENIZERS, file: str = VOCABULARY) -> ByteCounter:
    import public_tokenizers

    return ByteCounter(f"{folder}/{file}", public_tokenizers.PATTERN)


def _mix(s: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix(table(s, d, "token_counts"), table(s, d, "mix_targets"), table(s, d, "source_settings"))


def _related(s: SparkSession, d: str) -> DataFrame:
    return splits.related(table(s, d, "token_counts"), table(s, d, "manifests"))


def p1_mix(s, d):
    return _mix(s, d).chosen


def p1_shares(s, d):
    return _mix(s, d).shares


def p1_slots(s, d):
    return _mix(s, d).slots


def p1_check(s, d):
    """Of each target group: whether its actual share is the target to within a block, and no record and no block is used too often."""
    mix = _mix(s, d)
    total = mix.chosen.agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("all_tokens"))
    blocks = mix.slots.groupBy("source_group", "block").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("m")).groupBy("source_group").agg(F.max("n").alias("n"), F.bool_and(F.col("n") == F.col("m")).alias("once"))
    rows = mix.shares.join(F.broadcast(total)).join(blocks, "source_group", "left")  # the totals are one row
    near = F.abs(F.col("actual_share") - F.col("target_share")) * F.col("all_tokens") <= 2 * mixing.BLOCK
    kept = (F.col("most_uses") <= F.col("max_repeats")) & (F.coalesce("n", F.lit(0)) <= F.col("max_repeats")) & F.coalesce("once", F.lit(True))
    return rows.select("source_group", F.round("target_share", 9).alias("target_share"), "max_repeats", "tokens_available", near.alias("share_held"), kept.alias("repeats_held"))


def p2_check(s, d):
    """One row: records with a split, clusters and texts that the new split tears apart, and whether each split has its share to 1 %."""
    rows = _related(s, d)
    members = rows.select(F.col("document_id").alias("id"), "component").distinct()
    new = members.join(splits.assign(members), "component").select(F.col("id").alias("document_id"), F.col("split").alias("new"))
    per = new.groupBy("new").agg(F.count("*").alias("n"))
    share = F.coalesce(*[F.when(F.col("new") == name, F.lit(x)) for name, x in splits.PROPORTIONS])
    sums = per.agg(F.sum("n").alias("total"), F.collect_list(F.struct(F.col("n"), share.alias("x"))).alias("parts"))  # three splits
    each = rows.join(new, "document_id")
    tear = lambda key: each.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("new").alias("x"), F.max("new").alias("y")).where("x <> y").agg(F.count("*").alias(f"torn_{key}"))
    held = F.forall("parts", lambda p: F.abs(p.n - p.x * F.col("total")) <= 0.01 * F.col("total") + 1)
    return sums.select(F.coalesce("total", F.lit(0)).alias("records"), held.alias("shares_held")).join(F.broadcast(tear("cluster_id"))).join(F.broadcast(tear("text_hash")))  # one row each


def p2_found(s, d):
    return splits.torn(_related(s, d))


def p2_splits(s, d):
    members = _related(s, d).select(F.col("document_id").alias("id"), "component").distinct()
    return members.join(splits.assign(members), "component").select(F.col("id").alias("document_id"), "component", "split")


def p2_torn(s, d):
    return splits.torn_components(_related(s, d))


def p3_found(s, d):
    return components.matched(table(s, d, "near_edges"))


def p4_found(s, d):
    """Every pair; copies of one text beyond ``neardup.COPIES`` are given with their representative, and ``p4_classes`` has the membership."""
    found = neardup.near_pairs(texts(s, d), 0.85)
    return neardup.expand(found, most=neardup.COPIES).toDF("left_doc_id", "right_doc_id")


def p4_classes(s, d):
    return neardup.per_document(neardup.near_pairs(texts(s, d), 0.85))


def p5_budget(s, d):
    return budget.budget(texts(s, d), piece_counter(table(s, d, "tokenizer_pieces")), table(s, d, "token_counts"))


def p5_slices(s, d):
    """Documents of each slice and level of the budget; the tokens of each level's slices add up to those of all."""
    rows = p5_budget(s, d)
    names = ["source", "lang", "domain", "split"]
    level = F.concat_ws("", *[F.when(F.col(n).eqNullSafe("*"), "*").otherwise("-") for n in names])
    rows = rows.withColumn("level", level)
    sums = rows.groupBy("level").agg(F.sum("tokens").alias("t"))
    total = sums.where("level = '****'").select(F.col("t").alias("whole"))
    same = sums.join(F.broadcast(total)).select("level", (F.col("t") == F.col("whole")).alias("adds_up"))  # a row for each level, and one
    return rows.join(F.broadcast(same), "level").select(*names, "documents", "adds_up")


def p5_documents(s, d):
    tokens = budget.document_tokens(texts(s, d), piece_counter(table(s, d, "tokenizer_pieces")))
    return tokens.select(F.col("id").alias("doc_id"), "tokens", (F.col("tokens") + 1).alias("token_count"))  # with the end mark, as token_counts has it


def p6_found(s, d):
    return overlap.same_records(overlap.overlaps(table(s, d, "manifests"), texts(s, d)))


def p6_report(s, d):
    return overlap.report(table(s, d, "manifests"))


def p6_overlaps(s, d):
    found = overlap.overlaps(table(s, d, "manifests"), texts(s, d))
    return found.withColumnsRenamed({"e": "eval_id", "t": "train_id"})


def p6_texts(s, d):
    return overlap.contained_texts(table(s, d, "manifests"), texts(s, d))


def p6_members(s, d):
    return overlap.text_classes(overlap.text_records(table(s, d, "manifests"), table(s, d, "documents")))


def p7_sample(s, d):
    return sampling.sample(sampling.weights(table(s, d, "token_counts")))


def p8_sequences(s, d):
    return packing.sequences(texts(s, d), public_counter())


def p8_fill(s, d):
    return packing.fill(p8_sequences(s, d))


def p8_check(s, d):
    return packing.check(p8_sequences(s, d), budget.document_tokens(texts(s, d), public_counter()))


def p9_found(s, d):
    return leakage.leaks(texts(s, d), table(s, d, "benchmark_items")).select("doc_id", "item_id")


def p9_items(s, d):
    found = leakage.leaks(texts(s, d), table(s, d, "benchmark_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max(F.col("matched_words") / F.col("item_words")).alias("most_of_item"))


def p10_found(s, d):
    docs = texts(s, d)
    return langid.cases(langid.documents(docs, langid.fit(docs)))


def p10_documents(s, d):
    docs = texts(s, d)
    return langid.documents(docs, langid.fit(docs))


def p10_passages(s, d):
    docs = texts(s, d)
    return langid.passages(docs, langid.fit(docs))


def p10_check(s, d):
    """Of each document its letters, and whether its passages hold all of them, one after the other, each in another language than the one before."""
    before = Window.partitionBy("id").orderBy("begin")
    rows = p10_passages(s, d).distinct().withColumns({"last": F.lag("end").over(before), "same": F.lag("lang").over(before).eqNullSafe(F.col("lang")) & F.lag("end").over(before).isNotNull()})
    per = rows.where("id is not null").groupBy("id").agg(F.max("letters").alias("letters"), F.sum("passage_letters").alias("held"), F.bool_and(F.coalesce(F.col("begin") >= F.col("last"), F.lit(True)) & ~F.col("same")).alias("in_order"))
    return per.select(F.col("id").alias("doc_id"), "letters", (F.col("held") == F.col("letters")).alias("complete"), "in_order")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
