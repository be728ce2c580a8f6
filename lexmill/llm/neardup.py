"""Near-duplicate texts by b-bit MinHash (problem 4).

Texts are put in NFC form without white space; their distinct 5-character strings are hashed. A signature has
``FUNCTIONS`` x ``BINS`` minima: each hash function sends a string to one of its bins and keeps the least hash
in each bin (empty bins borrow from the next one). ``BANDS`` bands of ``ROWS`` minima, one row from each of
eight functions, give candidate pairs; the low 2 bits of every minimum, packed in eight 64-bit words, give a
similarity corrected for chance agreement from a bit count; what stays is verified on the sets of all strings, each of which is made once and goes
to the groups of pairs that need it. Texts are never shuffled.

Misses: a pair at similarity 0.85 shares no band with probability (1 - 0.85^8)^32 = 4e-5, less above.
Copies (equal text after the form above) are one class: candidates and links are found between classes.

Defined results: null, empty and blank texts, and texts under ``min_letters`` letters, take part in nothing.
Rows without id are left out; repeated rows of one id count once. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import arrays as A
from lexmill.operators.pairs import HOT, block_pairs
from lexmill.operators.similarity import scored
from lexmill.session import Stages, broadcast_if

FUNCTIONS, BINS, BANDS, ROWS, WORDS = 16, 16, 32, 8, 8
WIDTH = 5
#: How far below the threshold the estimate may lie, more than five standard deviations of 256 minima.
MARGIN = 0.17
#: Rows of ids that may be broadcast; more are shuffled.
SMALL = 200_000
#: Classes of more copies are given as members and representative.
COPIES = 1000
EMPTY = np.uint32(0xFFFFFFFF)


def compact(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """NFC without white space: code points, starts, letters of each text."""
    cps, starts = A.points(A.nfc(texts))
    letters = A.counts(A.is_letter(cps), starts)
    keep = ~A.is_space(cps)
    return cps[keep], A.offsets(A.counts(keep, starts)), letters


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima [text, bin, function] of each run of hashes; a run without hashes has EMPTY throughout."""
    n = len(starts) - 1
    out = np.full((FUNCTIONS, n * BINS), EMPTY, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    slot = np.repeat(np.arange(n, dtype=np.int64) * BINS, np.diff(starts))
    for f in range(FUNCTIONS):
        y = (x + low * np.uint32(2 * f)) * np.uint32((0x9E3779B1 + 0x3C6EF372 * f) & 0xFFFFFFFF | 1)
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum.at(out[f], slot + (y >> np.uint32(28)), y)
    sig = out.reshape(FUNCTIONS, n, BINS)
    full = sig.copy()
    for step in range(1, BINS):
        empty = full == EMPTY
        if not empty.any():
            break
        shifted = np.roll(sig, -step, axis=2)
        full = np.where(empty & (shifted != EMPTY), shifted + np.uint32(step * 0x01000193 & 0xFFFFFFFF), full)
    return full.transpose(1, 2, 0)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        h *= A.BASE
        h += rows[:, :, k]
    return A.mix(h).view(np.int64)


def packed(sig: np.ndarray) -> np.ndarray:
    """The low 2 bits of each minimum, 32 minima in a word."""
    y = sig.reshape(len(sig), -1).copy()
    y ^= y >> np.uint32(16)
    y *= np.uint32(0x85EBCA6B)
    y ^= y >> np.uint32(13)
    bits = (y & np.uint32(3)).astype(np.uint64).reshape(len(sig), WORDS, 32)
    return np.bitwise_or.reduce(bits << np.arange(0, 64, 2, dtype=np.uint64), axis=2).view(np.int64)


def _lists(values: np.ndarray) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _sketch(min_letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in A.slices(texts):
                cps, starts, letters = compact(texts[a:b])
                use = np.flatnonzero((letters >= min_letters) & (np.diff(starts) >= WIDTH))
                hashes, at = A.ngrams(cps, starts, WIDTH)
                sig = signatures(hashes, at)[use]
                keys = [hashlib.blake2b(cps[starts[i] : starts[i + 1]].tobytes(), digest_size=16).digest() for i in use]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(use)), pa.array(keys, pa.binary()), _lists(band_keys(sig)), _lists(packed(sig))],
                    names=["id", "text_key", "bands", "bits"],
                )

    return run


def _grams(texts: list[str]) -> list[np.ndarray]:
    """The distinct 5-character strings of each text, as sorted hashes."""
    cps, starts, _ = compact(texts)
    hashes, at = A.ngrams(cps, starts, WIDTH)
    return [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(texts))]


def estimate(left: str, right: str) -> Column:
    """Similarity from the bit count of two packed signatures, corrected for the quarter that agrees by chance."""
    wrong = sum(
        (F.bit_count(((x := F.col(left)[k].bitwiseXOR(F.col(right)[k])).bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555))) for k in range(WORDS)),
        F.lit(0),
    )
    return 1 - (wrong / (FUNCTIONS * BINS)) / 0.75


@dataclass
class NearPairs:
    """pairs(l, r, similarity) between class representatives; members(rep, id) of the classes with more than one text."""

    pairs: DataFrame
    members: DataFrame
    sketches: DataFrame
    spare: DataFrame


def near_pairs(docs: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 50, hot: int = HOT) -> NearPairs:
    """Find every pair of texts at or above the threshold. Each class of copies is represented by its least id."""
    spark = docs.sparkSession
    stages = Stages(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    kind = texts.schema["id"].dataType.simpleString()
    sketch = stages.put(texts.mapInArrow(_sketch(min_letters), f"id {kind}, text_key binary, bands array<bigint>, bits array<bigint>"))
    classes = sketch.groupBy("text_key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    members = stages.put(sketch.select("text_key", "id").join(classes, "text_key").select("rep", "id").distinct())
    spare = members.where("id <> rep").select("id")
    single = sketch.join(broadcast_if(spare, members.count(), SMALL), "id", "left_anti")
    bands = single.select("id", F.explode("bands").alias("key"))
    live = stages.put(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = bands.join(broadcast_if(live, live.count(), SMALL), "key")
    pairs = block_pairs(shared, "key", "id", "n", hot).distinct()
    bits = single.select("id", "bits")
    cand = (
        pairs.join(bits.toDF("l", "bl"), "l")
        .join(bits.toDF("r", "br"), "r")
        .where(estimate("bl", "br") >= threshold - MARGIN)
        .select("l", "r")
    )
    cand = stages.put(cand)
    checked = scored(cand, texts, threshold, _grams)
    out = stages.put(checked.distinct())
    stages.drop(live, cand)
    return NearPairs(out, members, sketch, spare)


def expand(found: NearPairs, hot: int = HOT, most: int | None = None) -> DataFrame:
    """All pairs of ids: links between classes carried over to their members, and the pairs inside each class.

    Where ``most`` is given, a class of more copies is not expanded: each of its members is paired with the class's
    representative, which alone carries its links, so that the result does not grow with the square of the copies; ``per_document`` has the
    membership from which the other pairs follow."""
    size = found.members.groupBy("rep").agg(F.count("*").alias("n"))
    sized = found.members.join(size, "rep")
    many = F.col("n") > most if most is not None else F.lit(False)
    few = sized.where(~many)
    inside = block_pairs(few, "rep", "id", "n", hot)
    stars = sized.where(many & (F.col("rep") != F.col("id"))).select(F.col("rep").alias("l"), F.col("id").alias("r"))
    own = few.select("rep", "id")
    across = found.pairs.join(own.toDF("l", "li"), "l", "left").join(own.toDF("r", "ri"), "r", "left").select(F.coalesce("li", "l").alias("a"), F.coalesce("ri", "r").alias("b"))
    return inside.unionByName(stars).unionByName(across.select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r")))


def per_document(found: NearPairs) -> DataFrame:
    """One row for each text that takes part: id, class_id (least id of its copies), copies, links (other classes linked to its class)."""
    ids = found.sketches.select("id").distinct()
    sizes = found.members.groupBy("rep").agg(F.count("*").alias("copies"))
    links = found.pairs.select(F.explode(F.array("l", "r")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        ids.join(found.members, "id", "left")
        .withColumn("rep", F.coalesce("rep", "id"))
        .join(sizes, "rep", "left")
        .join(links, "rep", "left")
        .select("id", F.col("rep").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    )
