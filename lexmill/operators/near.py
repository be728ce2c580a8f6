"""Near-duplicate groups from banded bottom-k fingerprints, exact similarity and components.

Defined results: documents whose text is null take part in nothing; no documents give no pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import arrays as A
from lexmill.functions import fingerprint, ids, text
from lexmill.operators.components import components
from lexmill.operators.pairs import block_pairs
from lexmill.operators.parts import close_pairs
from lexmill.operators.similarity import scored
from lexmill.session import Stages

THRESHOLD = 0.95


def bands(docs: DataFrame) -> DataFrame:
    """doc, band, key for documents (row_index, text). Written once: each document's fingerprint is computed once."""
    keys = docs.select(F.col("row_index").alias("doc"), fingerprint.prints_of(F.col("text")).alias("print")).select("doc", F.posexplode(fingerprint.band_keys(F.col("print"))).alias("band", "key"))
    return Stages(docs.sparkSession).put(keys)


def buckets(banded: DataFrame) -> DataFrame:
    return banded.groupBy("band", "key").agg(F.count("*").alias("size"))


def bucket_stats(banded: DataFrame, most: int = 10_000) -> DataFrame:
    """Of each band: buckets that collide, those within ``most``, skipped ones, the largest, and pairs tried."""
    b = buckets(banded).where("size > 1")
    fits = F.col("size") <= most
    return b.groupBy("band").agg(
        F.count("*").alias("colliding"), F.count_if(fits).alias("complete"), F.count_if(~fits).alias("skipped"), F.max("size").alias("largest"),
        F.coalesce(F.sum(F.when(fits, (F.col("size") * (F.col("size") - 1) / 2).cast("bigint"))), F.lit(0)).alias("pair_attempts"),
    )


def bucket_histogram(banded: DataFrame) -> DataFrame:
    s = F.col("size")
    label = F.when(s <= 10, "2-10").when(s <= 50, "11-50").when(s <= 100, "51-100").when(s <= 200, "101-200").when(s <= 500, "201-500").when(s <= 1000, "501-1000").otherwise(">1000")
    return buckets(banded).where("size > 1").groupBy(label.alias("bucket")).agg(F.count("*").alias("buckets"))


def candidates(banded: DataFrame) -> DataFrame:
    """l, r: each pair in one bucket of any band, once. Buckets of any size are complete."""
    sized = banded.join(buckets(banded).where("size > 1"), ["band", "key"])
    keyed = sized.select(F.concat_ws(":", "band", "key").alias("key"), "doc", "size")
    return block_pairs(keyed, "key", "doc", "size").distinct()


def verified(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """l, r, similarity of pairs whose lengths and shingle sets agree to the threshold; lengths are compared before texts are read."""
    slim = docs.select(F.col("row_index").alias("d"), F.length("text").alias("n"))
    lengths = pairs.join(slim.toDF("l", "nl"), "l").join(slim.toDF("r", "nr"), "r").where(F.least("nl", "nr") / F.greatest("nl", "nr") >= threshold).select("l", "r")
    return scored(lengths, docs.select(F.col("row_index").alias("id"), "text"), threshold, _shingles)


def _shingles(texts: list[str], width: int = text.WIDTH) -> list[np.ndarray]:
    """Of each text the distinct hashes of what ``text.shingles`` gives, in order."""
    hashes, at = _sets(texts, width)
    return [hashes[a:b] for a, b in zip(at, at[1:])]


def hash_of(word: str) -> int:
    """A number for a string shorter than a shingle, the same in every process."""
    return int.from_bytes(word.encode("utf-32-le", "surrogatepass").ljust(16, b"\xff"), "little") % 0xFFFFFFFFFFFFFFC5


def _sets(texts: list[str], width: int = text.WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """What ``_shingles`` gives, in one array, and where each text's hashes begin."""
    words = [" ".join(t.split()) for t in texts]
    hashes, at = A.ngrams(*A.points(words), width)
    for a, b in zip(at, at[1:]):
        hashes[a:b].sort()
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    first[at[:-1][at[:-1] < len(hashes)]] = True
    hashes, at = hashes[first], A.offsets(A.counts(first, at))
    if short := [i for i, w in enumerate(words) if 0 < len(w) < width]:
        own = A.mix(np.array([hash_of(words[i]) for i in short], np.uint64))
        hashes, at = np.insert(hashes, at[short], own), at + np.searchsorted(short, np.arange(len(at)))
    return hashes, at


def exact_edges(docs: DataFrame, threshold: float) -> DataFrame:
    """l, r, similarity: every pair at the threshold, without fingerprints. Only pairs with enough parts of their shingle sets in common are compared (see ``parts``)."""
    pairs = close_pairs(docs.select(F.col("row_index").alias("id"), "text"), threshold, _sets)
    return verified(Stages(docs.sparkSession).put(pairs), docs, threshold)


def recall(exact: DataFrame, candidate_pairs: DataFrame, levels=(0.80, 0.85, 0.90, 0.95)) -> DataFrame:
    """threshold, eligible, found, recall: how many of the true pairs are candidates."""
    flags = exact.join(candidate_pairs.select("l", "r", F.lit(1).alias("hit")), ["l", "r"], "left")
    rows = flags.select("similarity", "hit", F.explode(F.array(*map(F.lit, levels))).alias("threshold")).where("similarity >= threshold")
    return rows.groupBy("threshold").agg(F.count("*").alias("eligible"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("eligible"))


def transitivity(members: DataFrame, docs: DataFrame) -> DataFrame:
    """cluster_id, pairs, least_pair, least_to_representative: similarity inside clusters, also where no edge joins two members."""
    sized = members.join(members.groupBy("cluster_id").agg(F.count("*").alias("size")), "cluster_id")
    pairs = block_pairs(sized, "cluster_id", "rowid", "size")
    scored = verified(pairs, docs, 0.0)
    own = members.select(F.col("rowid").alias("l"), "cluster_id", F.col("representative_rowid").alias("rep"))
    to_rep = F.when((F.col("l") == F.col("rep")) | (F.col("r") == F.col("rep")), F.col("similarity"))
    return scored.join(own, "l").groupBy("cluster_id").agg(F.count("*").alias("pairs"), F.min("similarity").alias("least_pair"), F.min(to_rep).alias("least_to_representative"))


def leakage(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """l, r, split_l, split_r, similarity of near pairs whose ends are in different splits."""
    s = assigned.select(F.col("row_index").alias("d"), "split")
    return edges.join(s.toDF("l", "split_l"), "l").join(s.toDF("r", "split_r"), "r").where("split_l <> split_r")


def clusters(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """rowid, cluster_id, representative_rowid, removed: the document with the least document_id stands for its cluster."""
    named = components(edges).join(docs.select(F.col("row_index").alias("v"), "document_id"), "v")
    best = named.groupBy("label").agg(F.min(F.struct("document_id", "v")).alias("r"))
    return named.join(best, "label").select(
        F.col("v").alias("rowid"), ids.near_cluster_id(F.col("r.document_id")).alias("cluster_id"), F.col("r.v").alias("representative_rowid"), (F.col("v") != F.col("r.v")).cast("int").alias("removed")
    )


def distribution(members: DataFrame) -> DataFrame:
    """size, clusters."""
    return members.groupBy("cluster_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def invariants(members: DataFrame) -> DataFrame:
    """One row: clusters, those without exactly one kept member, with several representatives, and of one member."""
    per = members.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if(F.col("removed") == 0).alias("kept"), F.count_distinct("representative_rowid").alias("reps"))
    return per.agg(F.count("*").alias("clusters"), F.count_if(F.col("kept") != 1).alias("bad_kept"), F.count_if(F.col("reps") != 1).alias("bad_representative"), F.count_if(F.col("n") < 2).alias("single"))


def crossing_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose ends are in different clusters (there must be none)."""
    m = members.select("rowid", "cluster_id").distinct()
    return edges.join(m.toDF("l", "cl"), "l").join(m.toDF("r", "cr"), "r").where("cl <> cr")
