"""Mixing sources to target weights (problem 1).

The records of each group, in a pseudorandom order, are one stream of tokens, packed into blocks of ``BLOCK``
tokens (the last one shorter). The total is as large as the targets and ``max_repeats`` allow, or as asked for;
each group's share of it is a number of block slots. The slots are spread over output shards: how many of each group a shard gets is a
multinomial draw under the condition that the totals come out (a multivariate hypergeometric one), drawn by
halving the range of shards, so that each shard draws its own in a few steps, whatever the number of slots. Slot s of a group is block
perm(s mod blocks) of its epoch s div blocks, perm being a Feistel permutation of the block numbers keyed by group and epoch:
no block is used more often than the number of epochs, which max_repeats bounds. Blocks are then joined by number with the
records that stand in them; a record that spans blocks is used as often as its most used block.

Positions in the streams are running sums in two steps: totals of hash ranges first, then inside each range,
so that no task holds a group.

Defined results: only the latest row of a document counts; null, zero and negative counts, and groups without a
target, are left out; a null group is looked up by source in source_settings, if given; null or zero targets
get nothing; no records give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.records import latest, spelling
from lexmill.session import Stages, broadcast_if

BLOCK, SLOTS, RANGES, SEED = 1024, 1024, 1024, 2026
#: numpy draws from this many slots at most; from more, the distribution function is inverted here.
DRAWN = 500_000_000
#: Target groups; a larger table is no table of targets.
GROUPS = 10_000
#: Rows of source settings that may be broadcast; more are shuffled.
SMALL = 10_000


def _permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of range(n): four Feistel rounds over the next power of four, walked until inside."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            h = (right + np.uint64(key * 8 + r + 1 & 0xFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _large_draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw from any number of items: the distribution function, summed within twelve standard deviations of the mean, is inverted."""
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mean = n * (good / total)
    spread = 12 * np.sqrt(max(mean * (bad / total) * ((total - n) / max(total - 1, 1)), 0)) + 12
    k = np.arange(max(low, int(mean - spread)), min(high, int(mean + spread) + 1) + 1, dtype=np.float64)
    step = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    below = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(int(np.searchsorted(below, rng.random() * below[-1], "right")), len(k) - 1)])


@lru_cache(maxsize=4096)
def _first_half(seed: int, lo: int, hi: int, now: tuple[int, ...], size: int) -> tuple[int, ...]:
    """How many of each group's slots fall into the first half of the shards lo to hi, which has ``size`` slots."""
    rng, total = np.random.default_rng([seed, lo, hi]), sum(now)
    if total <= DRAWN:
        return tuple(rng.multivariate_hypergeometric(np.array(now), size, method="marginals").tolist())
    out = []
    for n in now:
        total -= n
        out.append(size if not total else _large_draw(rng, n, total, size) if n and size else 0)
        size -= out[-1]
    return tuple(out)


def _shard_counts(shard: int, shards: int, slots: np.ndarray, per_shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each group before this shard, and in it."""
    before, now, lo, hi = np.zeros_like(slots), slots.copy(), 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.array(_first_half(seed, lo, hi, tuple(now.tolist()), min(int(now.sum()), (mid - lo) * per_shard)), np.int64)
        if shard < mid:
            now, hi = left, mid
        else:
            before, now, lo = before + left, now - left, mid
    return before, now


@dataclass
class Mix:
    """chosen(document_id, source_group, source, token_count, uses, tokens_used); slots(shard, source_group, slot, block, epoch); shares."""

    chosen: DataFrame
    slots: DataFrame
    shares: DataFrame


def mix(counts: DataFrame, targets: DataFrame, settings: DataFrame | None = None, total_tokens: int | None = None, block: int = BLOCK, slots_per_shard: int = SLOTS, seed: int = SEED) -> Mix:
    spark = counts.sparkSession
    stages = Stages(spark)
    goals = targets.groupBy(spelling(F.col("source_group")).alias("g")).agg(
        F.min("source_group").alias("source_group"), F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")
    )
    rows = goals.where("g is not null").limit(GROUPS + 1).collect()
    if len(rows) > GROUPS:
        raise ValueError(f"there are at most {GROUPS} target groups")
    goals = sorted((r for r in rows if r.share and r.repeats and r.share > 0 and r.repeats > 0), key=lambda r: r.g)  # one row for each target group
    number = spark.createDataFrame([(i, r.g, r.source_group) for i, r in enumerate(goals)], "gi int, g string, source_group string")
    records = latest(counts).where("token_count > 0").select("document_id", "token_count", spelling(F.col("source")).alias("source"), spelling(F.col("source_group")).alias("g"))
    if settings is not None:
        known = settings.groupBy(spelling(F.col("source")).alias("source")).agg(F.min(spelling(F.col("source_group"))).alias("by_source")).where("source is not null")
        records = records.join(broadcast_if(known, known.count(), SMALL), "source", "left").withColumn("g", F.coalesce("g", "by_source")).drop("by_source")
    placed = records.join(F.broadcast(number), "g").select("document_id", "token_count", "source", "gi", F.xxhash64("document_id", F.lit(seed)).alias("h"))
    placed = stages.put(placed.withColumn("range", F.shiftrightunsigned("h", 54)))
    sums = placed.groupBy("gi", "range").agg(F.sum("token_count").alias("n"))
    before = Window.partitionBy("gi").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = stages.put(sums.select("gi", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n"))  # at most groups x RANGES rows
    have = {r.gi: r.n for r in sums.groupBy("gi").agg(F.sum("n").alias("n")).collect()}
    tokens = np.array([have.get(i, 0) for i in range(len(goals))], np.int64)
    blocks = -(-tokens // block)
    share = np.array([r.share for r in goals])
    repeats = np.array([r.repeats for r in goals], np.int64)
    share = np.where(tokens > 0, share, 0)
    share = share / share.sum() if share.sum() else share
    most = (repeats * tokens)[share > 0] / share[share > 0]
    total = min(most.min() if len(most) else 0, total_tokens if total_tokens is not None else np.inf)
    slots = np.minimum((total * share / block).astype(np.int64), repeats * blocks)
    shards = max(1, -(-int(slots.sum()) // slots_per_shard))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch.id:
                first, n = _shard_counts(int(shard), shards, slots, slots_per_shard, seed)
                group = np.repeat(np.arange(len(n)), n)
                s = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n) + first[group]
                epoch = s // np.maximum(blocks[group], 1)
                to = np.empty_like(s)
                for g, e in {*zip(group.tolist(), epoch.tolist())}:
                    at = (group == g) & (epoch == e)
                    to[at] = _permuted(s[at] % blocks[g], int(blocks[g]), int(seed * 1_000_003 + g * 65_537 + e))
                yield pd.DataFrame({"shard": shard, "gi": group.astype(np.int32), "slot": s, "block": to, "epoch": epoch.astype(np.int32)})

    drawn = spark.range(shards).mapInPandas(draw, "shard bigint, gi int, slot bigint, block bigint, epoch int")
    # the planner takes what a range of shards becomes for as small as the range; the hint keeps it from being broadcast
    used = drawn.groupBy("gi", "block").agg(F.count("*").alias("uses")).hint("merge")
    inside = Window.partitionBy("gi", "range").orderBy("h", "document_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.join(F.broadcast(sums.select("gi", "range", "before")), ["gi", "range"]).withColumn("end", F.col("before") + F.sum("token_count").over(inside))
    ends = ends.withColumn("start", F.col("end") - F.col("token_count"))
    pieces = ends.select("document_id", "source", "gi", "token_count", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    overlap = F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    chosen = (
        pieces.select("document_id", "source", "gi", "token_count", "block", overlap.alias("overlap"))
        .join(used, ["gi", "block"])
        .groupBy("document_id")
        .agg(F.first("gi").alias("gi"), F.first("source").alias("source"), F.first("token_count").alias("token_count"), F.max("uses").alias("uses"), F.sum(F.col("uses") * F.col("overlap")).alias("tokens_used"))
    )
    chosen = stages.put(chosen.join(F.broadcast(number.select("gi", "source_group")), "gi").select("document_id", "source_group", "source", "token_count", "uses", "tokens_used"))
    got = chosen.groupBy("source_group").agg(F.count("*").alias("records"), F.max("uses").alias("most_uses"), F.sum("tokens_used").alias("tokens_used"))
    goal = spark.createDataFrame([(r.source_group, float(s), int(r.repeats), int(t)) for r, s, t in zip(goals, share, tokens)], "source_group string, target_share double, max_repeats int, tokens_available bigint")
    everything = chosen.agg(F.sum("tokens_used")).first()[0] or 0
    shares = goal.join(got, "source_group", "left")
    shares = shares.select("source_group", "target_share", "max_repeats", "tokens_available", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), (F.coalesce("tokens_used", F.lit(0)) / F.lit(max(everything, 1))).alias("actual_share"))
    named = drawn.join(F.broadcast(number), "gi").select("shard", "source_group", "slot", "block", "epoch")
    return Mix(chosen, named, shares)
