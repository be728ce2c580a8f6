"""Same or near-same records across splits (problem 6).

Each record is a set of features: hashes of its word 5-grams where its text is at hand, and the identities that an
earlier stage gave it (text hash, duplicate cluster). The features of the evaluation records are partitioned by hash, the training
records are scanned for hits, and hits give pairs. Of the grams, only the rarest (1 - share) n + 1 of an evaluation record ask for training
records, since what contains ``share`` of it has one of them; the pairs found are given the containment of the evaluation record in the
training record, over all its grams. Texts are never shuffled: a bitmap of the evaluation grams goes to the scan of the texts, and only what it lets pass
is written. Equal texts of one side are one class in this search, given by its least id; ``text_classes`` has the members.

A feature that over ``HOT_SHARE`` of all features' rows carry (there are at most 1 / HOT_SHARE such features, which is
why their list may be broadcast) is cut into parts by a hash of the training record, and the evaluation rows
are repeated for each part, so that no task holds the group.

Defined results: null ids, null features and records outside the three splits take part in nothing; a record
never pairs with itself; repeated rows count once; a record with rows in several splits stands on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import arrays as A
from lexmill.functions import bitmap
from lexmill.llm.leakage import words
from lexmill.operators.records import spelling, split_name
from lexmill.session import Stages, broadcast_if, hex64

#: A feature of more than this share of a side's features is split into parts.
HOT_SHARE = 0.001
PARTS = 64
#: Rows of huge features that may be broadcast; more are shuffled.
SMALL = 10_000
#: Ids of documents that may be broadcast; more are shuffled.
IDS = 200_000
#: Features of one record up to which its pairs are counted by subsets of them.
WIDE = 4
WORDS = 5
CONTAINED = 0.8


def identities(manifests: DataFrame) -> DataFrame:
    """id, split, feature: the text hash and the cluster of each record, each once."""
    names = F.array(
        F.concat(F.lit("h"), hex64(F.col("canonical_text_hash"))),
        F.concat(F.lit("c"), hex64(F.col("duplicate_cluster_id"))),
    )
    rows = manifests.select(F.col("document_id").alias("id"), split_name(F.col("split")).alias("split"), F.explode(F.array_compact(names)).alias("name"))
    # 128 bits of a 256-bit hash are kept: half the shuffle, and no two of 10^15 values are likely to meet
    return rows.where("id is not null and split is not null").select("id", "split", F.concat(F.substring("name", 1, 1), F.substring("name", 2, 32)).alias("feature"))


def _grams(sent=None):
    """id, feature, total: hashes of the distinct word 5-grams of texts, and how many a text has; with a bitmap, those that it lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in A.slices(texts):
                hashes, bounds = words(texts[a:b])
                grams, at = A.ngrams(hashes, bounds, WORDS)
                owner = np.repeat(np.arange(b - a), np.diff(at))
                if sent is not None:
                    hit = bitmap.passed(sent.value, grams)
                    grams, owner = grams[hit], owner[hit]
                order = np.lexsort((grams, owner))
                grams, owner = grams[order], owner[order]
                new = np.ones(len(grams), bool)
                new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
                owner = owner[new]
                total = np.bincount(owner, minlength=b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + a)), pa.array(grams[new].view(np.int64)), pa.array(total[owner], pa.int64())], names=["doc", "feature", "total"])

    return run


def hits(features: DataFrame, most_pairs: int | None = None, apart: bool = True) -> DataFrame:
    """e, t, n: evaluation record, training record, number of features in both; of identities also same_text, same_cluster: which of them they are.
    ``apart``: an id is not met with itself.

    Every pair is made, unless the caller names ``most_pairs``: then a feature that would make more is given by representatives, each of
    its evaluation records with the least training record, and the least evaluation record with each training record. No query does."""
    stages = Stages(features.sparkSession)
    train = features.where("split = 'train'").select(F.col("id").alias("t"), "feature")
    test = features.where("split <> 'train'").select(F.col("id").alias("e"), "feature")
    is_train = F.col("split") == "train"
    tally = features.groupBy("feature").agg(F.count_if(is_train).alias("nt"), F.count_if(~is_train).alias("ne"), F.min(F.when(is_train, F.col("id"))).alias("rep_t"), F.min(F.when(~is_train, F.col("id"))).alias("rep_e"))
    both = stages.put(tally.where("nt > 0 and ne > 0"))
    total = both.agg(F.sum(F.col("nt") + F.col("ne"))).first()[0] or 0
    huge = both.where(F.col("nt") * F.col("ne") > (most_pairs or 0)).select("feature", "rep_t", "rep_e")
    count = huge.count() if most_pairs is not None else 0
    if count:
        huge = broadcast_if(huge, count, SMALL)
        stars = test.join(huge, "feature").select("e", F.col("rep_t").alias("t"), "feature").unionByName(train.join(huge, "feature").select(F.col("rep_e").alias("e"), "t", "feature"))
        test, train = (x.join(huge.select("feature"), "feature", "left_anti") for x in (test, train))
    hot = F.broadcast(both.where(F.col("nt") + F.col("ne") > F.greatest(F.lit(1000), F.lit(HOT_SHARE * total))).select("feature", F.lit(PARTS).alias("parts")))
    left = test.join(hot, "feature", "left").select("e", "feature", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    right = train.join(hot, "feature", "left").select("t", "feature", F.pmod(F.xxhash64("t"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    met = left.join(right, ["feature", "part"]).select("e", "t", "feature")
    if count:
        met = met.unionByName(stars)
    named = features.schema["feature"].dataType.simpleString() == "string"
    kinds = [F.bool_or(F.col("feature").startswith(k)).alias(name) for k, name in (("h", "same_text"), ("c", "same_cluster"))] if named else []
    return (met.where("e <> t") if apart else met).distinct().groupBy("e", "t").agg(F.count("*").alias("n"), *kinds)


def same_records(found: DataFrame) -> DataFrame:
    """left_document_id, right_document_id: of the overlaps, those with an identity in common."""
    found = found.where("same_text or same_cluster")
    return found.select(F.least("e", "t").alias("left_document_id"), F.greatest("e", "t").alias("right_document_id")).distinct()


def text_records(manifests: DataFrame, docs: DataFrame) -> DataFrame:
    """id, side, doc, key: the records whose text is at hand, with the document that has it and the text's digest; a record with several texts has several rows."""
    records = manifests.where("document_id is not null and doc_rowid is not null").select(F.col("document_id").alias("id"), F.col("doc_rowid").alias("doc"), split_name(F.col("split")).alias("split")).where("split is not null")
    records = records.select("id", F.when(F.col("split") == "train", "train").otherwise("evaluation").alias("side"), "doc").distinct()
    keys = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), F.unhex(F.sha2("text", 256)).alias("key")).distinct()
    return records.join(keys, "doc")


def text_classes(records: DataFrame) -> DataFrame:
    """id, side, rep, copies: the records of training and of evaluation, and the least id on their side with the same text. ``records`` as of ``text_records``."""
    keyed = records.select("id", "side", "key").distinct()
    reps = keyed.groupBy("side", "key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    return keyed.join(reps, ["side", "key"]).select("id", "side", "rep", "copies")


class _Texts:
    """The texts at hand: one document for each class of equal texts of a side, and the grams of both sides' documents that matter."""

    def __init__(self, manifests: DataFrame, docs: DataFrame):
        spark, self.stages = manifests.sparkSession, Stages(manifests.sparkSession)
        records = text_records(manifests, docs)
        self.classes = self.stages.put(records.groupBy("side", "key").agg(F.min("id").alias("id"), F.min("doc").alias("doc"), F.count_distinct("id").alias("copies")).drop("key"))
        asked = self.classes.where("side = 'evaluation'").select(F.col("doc").alias("e")).distinct()
        texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), "text")
        shape = f"doc {docs.schema['doc_id'].dataType.simpleString()}, feature bigint, total bigint"
        needed = texts.join(broadcast_if(asked, asked.count(), IDS), F.col("doc") == F.col("e"), "left_semi")
        grams = needed.mapInArrow(_grams(), shape).groupBy(F.col("doc").alias("e"), "feature").agg(F.max("total").alias("eval_grams"))
        self.test = self.stages.put(grams)
        features = self.stages.put(self.test.select("feature").distinct())
        sent = spark.sparkContext.broadcast(bitmap.build(features, features.count()))
        # the scan writes only what evaluation texts have too, but for what the bitmap lets pass by chance, which finds no partner
        own = self.classes.where("side = 'train'").select("doc").distinct()
        self.train = self.stages.put(texts.mapInArrow(_grams(sent), shape).join(own, "doc").select(F.col("doc").alias("t"), "feature").distinct())

    def candidates(self, share: float) -> DataFrame:
        """e, t: documents that share one of the rarest grams of the evaluation document."""
        often = self.train.groupBy("feature").agg(F.count("*").alias("nt"))
        rarest = Window.partitionBy("e").orderBy(F.coalesce("nt", F.lit(0)), "feature")
        probes = self.test.join(often, "feature", "left").withColumn("k", F.row_number().over(rarest)).where((F.col("k") <= F.col("eval_grams") - F.ceil(share * F.col("eval_grams")) + 1) & F.col("nt").isNotNull())
        asked = probes.select(F.col("e").alias("id"), F.lit("evaluation").alias("split"), "feature").unionByName(self.train.select(F.col("t").alias("id"), F.lit("train").alias("split"), "feature"))
        return self.stages.put(hits(asked, apart=False).select("e", "t"))

    def contained(self, share: float) -> DataFrame:
        """e, t, shared, eval_grams, containment, eval_copies, train_copies: records, of least ids of equal texts, in which the first's grams stand to ``share`` in the second."""
        pairs = self.candidates(share).join(self.test, "e").join(self.train, ["t", "feature"])
        found = pairs.groupBy("e", "t").agg(F.count("*").alias("shared"), F.max("eval_grams").alias("eval_grams"))
        found = found.withColumn("containment", F.col("shared") / F.col("eval_grams")).where(F.col("containment") >= share)
        side = lambda name, k, copies: self.classes.where(f"side = '{name}'").select(F.col("doc").alias(k), F.col("id").alias(f"{k}_id"), F.col("copies").alias(copies))
        named = found.join(side("evaluation", "e", "eval_copies"), "e").join(side("train", "t", "train_copies"), "t").where("e_id <> t_id")
        return named.select(F.col("e_id").alias("e"), F.col("t_id").alias("t"), "shared", "eval_grams", "containment", "eval_copies", "train_copies").dropDuplicates(["e", "t"])


def overlaps(manifests: DataFrame, docs: DataFrame, share: float = CONTAINED) -> DataFrame:
    """e, t, same_text, same_cluster, shared, eval_grams, containment: every pair of an evaluation and a training record that has a text hash or
    a cluster in common, or whose texts are at hand and the evaluation record's word 5-grams stand to ``share`` in the training record
    (else these three are null; for equal texts of one side, they are given for their least ids)."""
    near = _Texts(manifests, docs).contained(share).drop("eval_copies", "train_copies")
    found = hits(identities(manifests)).drop("n").join(near, ["e", "t"], "full")
    return found.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("same_text", "same_cluster")})


def contained_texts(manifests: DataFrame, docs: DataFrame, share: float = CONTAINED) -> DataFrame:
    """eval_id, train_id, shared, eval_grams, containment, eval_copies, train_copies: the part of ``overlaps`` that the texts at hand give, with the number of
    records that each id stands for."""
    return _Texts(manifests, docs).contained(share).withColumnsRenamed({"e": "eval_id", "t": "train_id"})


def _subsets(features: str) -> Column:
    """All non-empty subsets of a sorted array of features."""
    every = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size(features)) - 1).cast("int"))
    return F.transform(every, lambda m: F.filter(features, lambda _, i: F.getbit(m, i) == 1))


def _shared_features(features: DataFrame, stages: Stages) -> DataFrame:
    """id, e_features, t_features: the features that each record has as evaluation and as training record, of those that both sides
    have, sorted; found: whether another record is met."""
    is_train = F.col("split") == "train"
    rows = features.select("id", is_train.alias("train"), "feature")
    # repeated rows count once, here and below; a feature's records are counted only as none, one or more of each side
    tally = rows.groupBy("feature").agg(F.count("*").alias("size"), F.min(F.when(F.col("train"), F.col("id"))).alias("t0"), F.max(F.when(F.col("train"), F.col("id"))).alias("t1"), F.count_if(~F.col("train")).alias("ne"))
    both = stages.put(tally.where("t0 is not null and ne > 0").select("feature", "size", (F.col("t0") < F.col("t1")).alias("several")))
    total = both.agg(F.sum("size")).first()[0] or 0
    hot = F.broadcast(both.where(F.col("size") > F.greatest(F.lit(1000), F.lit(HOT_SHARE * total))).select("feature", F.lit(PARTS).alias("parts")))
    left = rows.join(hot, "feature", "left").select("id", "train", "feature", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    right = both.join(hot, "feature", "left").select("feature", "several", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    met = left.join(right, ["feature", "part"])
    e, t = (F.sort_array(F.collect_set(F.when(side, F.col("feature")))) for side in (~F.col("train"), F.col("train")))
    many = F.collect_set(F.when(F.col("several"), F.col("feature")))
    sets = met.groupBy("id").agg(e.alias("e_features"), t.alias("t_features"), many.alias("many"))
    found = F.exists("e_features", lambda f: F.array_contains("many", f) | ~F.array_contains("t_features", f))
    return stages.put(sets.select("id", "e_features", "t_features", found.alias("found")))


def report(manifests: DataFrame, wide: int = WIDE) -> DataFrame:
    """split, source, pairs, records: overlaps of each evaluation split and source with training.

    Pairs are counted and not made: an evaluation record meets as many training records as hold one of its features or another, less
    those that hold both, and so on over the subsets of its features, less itself. Only pairs with a record of more than ``wide``
    features (a record has two, unless its rows contradict each other) are made one by one."""
    stages = Stages(manifests.sparkSession)
    ids = _shared_features(identities(manifests), stages)
    own = manifests.select(F.col("document_id").alias("id"), split_name(F.col("split")).alias("split"), spelling(F.col("source")).alias("source"))
    own = own.where("split <> 'train'").groupBy("id", "split").agg(F.min("source").alias("source"))
    records = stages.put(ids.where("size(e_features) > 0").join(own, "id"))
    wide_e, wide_t = F.size("e_features") > wide, F.size("t_features") > wide
    holders = ids.where(~wide_t & (F.size("t_features") > 0)).select(F.explode(_subsets("t_features")).alias("subset")).groupBy("subset").agg(F.count("*").alias("nt"))
    asking = records.where(~wide_e).select("split", "source", F.explode(_subsets("e_features")).alias("subset")).groupBy("split", "source", "subset").agg(F.count("*").alias("ne"))
    sign = F.when(F.size("subset") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    parts = asking.join(holders, "subset").select("split", "source", (sign * F.col("ne") * F.col("nt")).alias("pairs"), F.lit(0).alias("records"))
    itself = ~wide_e & ~wide_t & F.arrays_overlap("e_features", "t_features")
    parts = parts.unionByName(records.select("split", "source", (-itself.cast("bigint")).alias("pairs"), F.col("found").cast("int").alias("records")))
    if ids.where(wide_e | wide_t).limit(1).count():
        of = lambda where, side: ids.where(where).select("id", F.lit("train" if side == "t" else "test").alias("split"), F.explode(f"{side}_features").alias("feature"))
        made = hits(of(wide_e, "e").unionByName(of(F.lit(True), "t"))).unionByName(hits(of(~wide_e, "e").unionByName(of(wide_t, "t"))))
        parts = parts.unionByName(made.join(own, made["e"] == own["id"]).select("split", "source", F.lit(1).cast("bigint").alias("pairs"), F.lit(0).alias("records")))
    return parts.groupBy("split", "source").agg(F.sum("pairs").alias("pairs"), F.sum("records").alias("records")).where("records > 0")
