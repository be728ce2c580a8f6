"""Pairs of texts whose shingle sets may agree to a threshold, without fingerprints: no such pair is missed.

Two sets of n and m members with similarity t differ in at most (n + m)(1 - t)/(1 + t) members. Members are dealt to that many parts and some
more by their hash, so that some parts have equal members in both sets. Parts lie in ranges, and there are enough of them for at least ``MATCHES``
equal ones in one range, which is what a pair must have there. A set sends only as many parts as that takes, those whose members are rarest; as the
weight of a part follows from its members alone, of two sets the one that asks for rarer parts finds them all among those of the other.

Sets meet by size, in levels that hold two classes of sizes; every pair that can agree is in one class or in two that adjoin. A row is all that a batch
sends to one range of one level, so that neither shingles nor parts are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import arrays as A

U64 = np.uint64
#: Equal parts that a pair must have in one range, most ranges of a level, differing members for one range, parts in stock for each one needed.
MATCHES, RANGES, PER_RANGE, STOCK = 4, 12, 16, 1.3
#: Entries of the table of weights, and texts from which it is counted. It orders parts and nothing else: with any table the pairs at the threshold are all there.
WEIGHTS, COUNTED = 1 << 22, 2000
#: Bytes of a part's digest. Those that agree by chance only give pairs that are compared in vain.
DIGEST = 3
#: Matches that are counted at once.
CHUNK = 1 << 21

Sets = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def bounds(threshold: float, largest: int) -> np.ndarray:
    """Least sizes of the classes, to two beyond the one of the largest: sets of which the smaller has threshold x the larger's size are at most one class apart."""
    b = [1]
    while len(b) < 4 or b[-4] <= largest:
        b.append(max(b[-1] + 1, int(np.ceil(b[-1] / threshold - 1e-9))))
    return np.array(b)


def differing(threshold: float, total: np.ndarray | int):
    """How many members two sets of so many in total may differ in."""
    return np.floor((1 - threshold) / (1 + threshold) * np.asarray(total) + 1e-6).astype(np.int64)


def level_of(threshold: float, top: int) -> tuple[int, int]:
    """Ranges and parts of a level whose largest size is ``top``."""
    most = int(differing(threshold, 2 * top))
    ranges = min(max(most // PER_RANGE, 1), RANGES)
    return ranges, int(np.ceil((most + ranges * (MATCHES - 1) + 1) * STOCK))


def digests(h: np.ndarray, n: np.ndarray, weight: np.ndarray, parts: int, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[set, part]: the digest of the members in each part, and whether the set (of ``n`` hashes in order in ``h``) sends it."""
    shape = (len(n), parts)
    part = ((h >> U64(32)) * U64(parts)) >> U64(32)  # in order, as the hashes are
    slot = np.repeat(np.arange(len(n), dtype=np.int64) * parts, n) + part.view(np.int64)
    start = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    held, rarity = np.zeros(shape, U64), np.zeros(shape, np.int64)
    held.ravel()[slot[start]] = np.add.reduceat(h * A.BASE, start)
    rarity.ravel()[slot[start]] = np.add.reduceat(weight, start)
    held += np.arange(1, parts + 1, dtype=U64) * U64(0xA0761D6478BD642F)
    least = np.sort(rarity, axis=1)[np.arange(len(n)), parts - needed]  # at 0 empty parts are sent too
    return A.mix(held) >> U64(64 - 8 * DIGEST), rarity >= least[:, None]


def _sent(sets: Sets, threshold: float, weights):
    """A batch's rows: level, range, ids, for each id how many parts it sends and its set's size, and the digests one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            texts, out = batch.column(1).to_pylist(), {}
            for a, b in A.slices(texts):
                h, at = sets(texts[a:b])
                n = np.diff(at)
                low = bounds(threshold, int(n.max()))
                weight = weights.value[(h & U64(WEIGHTS - 1)).view(np.int64)].astype(np.int64)
                home = np.searchsorted(low, n, side="right") - 1  # -1: an empty set
                for level in np.unique(np.concatenate([home[n > 0], home[n > 0] + 1])):
                    own = (n > 0) & ((home == level) | (home == level - 1))
                    size, top = n[own], low[level + 1] - 1
                    ranges, parts = level_of(threshold, int(top))
                    partner = np.minimum(top, np.floor(size / threshold + 1e-6).astype(np.int64))
                    needed = differing(threshold, size + partner) + ranges * (MATCHES - 1) + 1
                    members = np.repeat(own, n)
                    digest, sent = digests(h[members], size, weight[members], parts, needed)
                    for r in range(ranges):
                        use = sent[:, r::ranges]
                        raw = digest[:, r::ranges][use].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :DIGEST]
                        out.setdefault((int(level), r), []).append((a + np.flatnonzero(own), use.sum(axis=1), size, raw))
            ids, keys = batch.column(0), list(out)
            each = [[np.concatenate(x) for x in zip(*out[k])] for k in keys]
            if keys:
                places = np.concatenate([x[0] for x in each])
                lists = pa.ListArray.from_arrays(pa.array(A.offsets(np.array([len(x[0]) for x in each])).astype(np.int32)), ids.take(pa.array(places)))
                facts = [np.stack([x[1], x[2]]).astype(np.int32).tobytes() for x in each]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), lists, pa.array(facts, pa.binary()), pa.array([x[3].tobytes() for x in each], pa.binary())],
                    names=["level", "range", "ids", "facts", "digests"],
                )

    return run


def matched(code: np.ndarray, n: np.ndarray, own: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the sets that share ``MATCHES`` digests. ``code``: digest and, in the low 40 bits, place of the set; ``n``: sizes by place, in order; ``own``: the first
    place of the upper class. Pairs of which both are before it have met in their own level. A set may be given as its own partner."""
    low = U64((1 << 40) - 1)
    code = np.sort(code)
    same = (code[1:] ^ code[:-1]) <= low
    shared = np.zeros(len(code), bool)
    shared[1:] = same
    shared[:-1] |= same
    code = code[shared]  # half of all digests have no equal
    place = (code & low).view(np.int64)
    # partners are the later ones of a digest, up to the largest size that can agree and, for a set of the lower class, from the upper class on
    far = np.searchsorted(n, (n + 1e-6) / threshold, side="right")
    head = code & ~low
    upto = np.searchsorted(code, head | far[place].astype(U64))
    since = np.arange(1, len(code) + 1)
    before = place < own
    since[before] = np.searchsorted(code, head[before] | U64(own))
    many = upto - since
    order = np.flatnonzero(many > 0)
    order = order[np.argsort(place[order], kind="stable")]
    place, first, since, many = place.astype(np.int32), place[order], since[order], many[order]
    # cut between sets; a set that many share may alone exceed a chunk, by the number of sets at most for each of its parts
    total = A.offsets(many)
    edge = np.append(np.flatnonzero(np.diff(first, prepend=-1)), len(first))
    cuts = np.unique(edge[np.searchsorted(total[edge], np.arange(0, total[-1] + CHUNK, CHUNK)).clip(max=len(edge) - 1)])
    for a, b in zip(cuts, cuts[1:]):
        y = np.repeat(since[a:b] - (total[a:b] - total[a]), many[a:b])
        y += np.arange(len(y))
        pair = np.repeat(first[a:b] * len(n), many[a:b])
        pair += place[y]
        pair.sort()
        pair = pair[MATCHES - 1 :][pair[MATCHES - 1 :] == pair[: max(len(pair) - MATCHES + 1, 0)]]
        often = pair[np.diff(pair, prepend=-1) > 0]
        yield often // len(n), often % len(n)


def _met(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        ids = pa.concat_arrays([x.flatten() for x in rows["ids"].chunks])
        sent, n = np.concatenate([np.frombuffer(x.as_py(), np.int32).reshape(2, -1) for x in rows["facts"]], axis=1).astype(np.int64)
        raw = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in rows["digests"]]).reshape(-1, DIGEST)
        by_size = np.argsort(n, kind="stable")
        place = np.empty(len(n), U64)
        place[by_size] = np.arange(len(n), dtype=U64)
        code = np.repeat(place, sent)
        for k in range(DIGEST):
            code |= raw[:, k].astype(U64) << U64(40 + 8 * k)
        n, ids = n[by_size], ids.take(pa.array(by_size))
        own = int(np.searchsorted(n, bounds(threshold, int(n[-1]))[rows["level"][0].as_py()]))
        none = np.zeros(0, np.int64)
        x, y = (np.concatenate(p) for p in zip((none, none), *matched(code, n, own, threshold)))
        x, y = ids.take(pa.array(x)), ids.take(pa.array(y))
        ordered = pc.less(x, y)
        out = pa.table({"l": pc.if_else(ordered, x, y), "r": pc.if_else(ordered, y, x)})
        return out.filter(pc.not_equal(out["l"], out["r"]))

    return run


def _buckets(sets: Sets):
    """For each batch the entries of the table of weights that its sets' members have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t is not None]
            for a, b in A.slices(texts):
                h, _ = sets(texts[a:b])
                at, count = np.unique((h & U64(WEIGHTS - 1)).astype(np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([count.astype(np.uint32).tobytes()], pa.binary()), pa.array([b - a], pa.int32())], names=["at", "count", "sets"])

    return run


def weights_of(docs: DataFrame, sets: Sets) -> np.ndarray:
    """By the low bits of a member's hash, how rare it is among some of the texts (id, text), in eighths of a bit, at least 1."""
    one_in = max(1, docs.count() // COUNTED)
    some = docs.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(one_in)) == 0).select("text")
    held, total = np.zeros(WEIGHTS, np.uint32), 0
    for row in some.mapInArrow(_buckets(sets), "at binary, count binary, sets int").toLocalIterator():
        held[np.frombuffer(row["at"], np.uint32)] += np.frombuffer(row["count"], np.uint32)
        total += row["sets"]
    return np.clip(np.round(8 * np.log2(max(total, 1) / np.maximum(held, 0.5))), 1, 255).astype(np.uint8)


def close_pairs(docs: DataFrame, threshold: float, sets: Sets) -> DataFrame:
    """l, r: among others, every pair of ids whose texts' sets agree to the threshold. ``docs`` has id and text; null texts and empty sets are in no pair.
    ``sets`` gives the distinct hashes of each text in order, one after the other, and where each begins."""
    weights = docs.sparkSession.sparkContext.broadcast(weights_of(docs, sets))
    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", "text").mapInArrow(_sent(sets, threshold, weights), f"level int, range int, ids array<{kind}>, facts binary, digests binary")
    return rows.groupBy("level", "range").applyInArrow(_met(threshold), f"l {kind}, r {kind}").distinct()
