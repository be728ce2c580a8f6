"""Held-out passages inside corpus texts, by size-partitioned MinHash containment search (problem 9).

Texts and items are folded (case, accents, look-alike letters, punctuation, markup, invisible characters, line
ends) and cut into words. Items are put into partitions by size, each reaching to ``STEP`` times its smallest
item. A document is seen as overlapping windows, one beginning every ``BLOCK`` words and as wide as the
partition's largest item, so that a passage of any item fits whole into a window and the containment of the
item in the document becomes a resemblance of like-sized sets. ``FUNCTIONS`` minima of the three-word
shingles of each window are compared with the items' minima: one equal minimum makes a candidate. With half
of an item's words in the window and one in six wrong the resemblance is 0.1 at least, and a miss has
probability 0.9^96 = 4e-5; that holds for items that are not short. Items under ``EXACT`` words are looked up by all their
three-word shingles (by all strings of half their words, if that is fewer), which misses none: a run of three words or more with at most one in
six wrong has three right ones on end. (Five-word shingles at 0.8 would miss these cases: with every sixth word wrong,
hardly a five-word shingle is left.) Candidates are verified by exact shingle containment, and then by the longest run
in the item's order with at most one word in six wrong: a document holds an item if that run reaches over half of the item's words, wrong ones and ends included.

Up to ``ITEMS`` items are a stated query set, sent to every task, and nothing is shuffled. More items are never gathered: their minima
are an index table, the one scan of the corpus gives the minima of its windows that a bitmap of the index lets pass, both are joined, and
the documents and items of the candidates are brought together for verification.

Defined results: null and empty texts or items match nothing; rows without id are left out; repeated rows give a pair once for each row before
the final distinct.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import arrays as A
from lexmill.functions import bitmap
from lexmill.session import Stages, broadcast_if

SHINGLE, FUNCTIONS, BLOCK, STEP, EXACT = 3, 96, 16, 1.5, 32
#: Items that may be sent to every task.
ITEMS = 5000
#: One word of a run in so many may be wrong.
WRONG = 6
NONE = np.uint32(0xFFFFFFFF)
DROP = np.uint32(0xFFFFFFFF)

# Letters of other scripts that look like Latin ones, lower case after case folding.
LOOK_ALIKES = dict(
    zip(
        "авекмнорстухіјѕһԁԛԝәғүөґєїќαβεηικμνορτυχγωґзбь",
        "abekmhopctyxijshdqweguogeikabehikmvoptuxywg36b",
    )
)
# Latin letters that lose a mark which no decomposition shows.
PLAIN = dict(zip("əıøłđħŧæœßɑɡ", "eioldhtaosag"))
# Apostrophes and the like, which stand inside words.
INSIDE = "'’‘ʼ`´ʻʹ′"

_tag = re.compile(r"<(/?)([A-Za-z!][A-Za-z0-9]*)[^<>]{0,300}>")
_inline = {"a", "abbr", "b", "big", "em", "font", "i", "mark", "s", "small", "span", "strong", "sub", "sup", "tt", "u", "wbr"}
_broken = re.compile("[-‐‑­¬][ \t]*\r?\n[ \t]*")


def _fold(ch: str) -> int:
    kind = unicodedata.category(ch)
    if ch in INSIDE or kind in ("Cf", "Mn", "Me", "Lm", "Sk", "Cs") or (kind == "Cc" and not ch.isspace()) or ch == "�":
        return int(DROP)
    base = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).casefold())
    for c in base:
        if c.isalnum():
            c = LOOK_ALIKES.get(c, PLAIN.get(c, c))
            return ord(c)
    return 0


def _fold_table() -> np.ndarray:
    if "fold" not in A._tables:
        size = 0x20000
        table = np.zeros(0x110000, np.uint32)
        table[:size] = np.fromiter((_fold(chr(i)) for i in range(size)), np.uint32, size)
        table[size:] = np.arange(size, 0x110000, dtype=np.uint32)
        table[0xE0000:] = DROP
        A._tables["fold"] = table
    return A._tables["fold"]


def plain(text: str) -> str:
    """Markup, character references and words broken at a line end undone."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _tag.sub(lambda m: "" if m[2].lower() in _inline else " ", text)
    if "\n" in text:
        text = _broken.sub("", text)
    return text


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words of all texts, and where each text's words start."""
    cps, starts = A.points([plain(t) for t in texts])
    folded = _fold_table()[cps]
    keep = folded != DROP
    at = A.offsets(A.counts(keep, starts))
    hashes, _, bounds = A.word_hashes(folded[keep], at)
    return hashes, bounds


def _function(x: np.ndarray, f: int) -> np.ndarray:
    y = x * np.uint32((0x9E3779B1 + 0x7F4A7C16 * f) & 0xFFFFFFFF | 1)
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x2C1B3C6D)
    return y


def _short(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint32)


def looked_up(n: int) -> int:
    """Words of the strings by which a short item of n words is looked up: half of the item, three at most."""
    return min(SHINGLE, -(-n // 2))


class Items:
    """Items in size partitions, with their minima ready to be looked up. Small enough to be sent to every task."""

    def __init__(self, ids: list, texts: list[str]):
        hashes, bounds = words(texts)
        order = sorted((int(bounds[i + 1] - bounds[i]), i) for i in range(len(ids)))
        self.ids, self.words, self.shingles, self.parts = [], [], [], []
        exact: dict[int, list[tuple[int, int]]] = {}
        group: list[int] = []
        for n, i in order:
            if not n:
                continue
            if group and n > STEP * len(self.words[group[0]]):
                self.parts.append(group)
                group = []
            own = hashes[bounds[i] : bounds[i + 1]]
            if n < EXACT:
                k = looked_up(n)
                grams = A.ngrams(own, np.array([0, n]), k)[0]
                exact.setdefault(k, []).extend((int(g), len(self.ids)) for g in grams)
            else:
                group.append(len(self.ids))
            self.ids.append(ids[i])
            self.words.append(own)
            self.shingles.append(np.unique(A.ngrams(own, np.array([0, len(own)]), SHINGLE)[0]))
        if group:
            self.parts.append(group)
        #: By number of words: the sorted strings of so many words of the short items, and each one's item.
        self.exact = {k: (np.array([g for g, _ in sorted(rows)], np.uint64), [i for _, i in sorted(rows)]) for k, rows in exact.items()}
        self.widths = [-(-max(len(self.words[i]) for i in g) // BLOCK) + 1 for g in self.parts]
        self.minima = [[self._least(g, f) for f in range(FUNCTIONS)] for g in self.parts]

    def _least(self, group: list[int], f: int) -> tuple[np.ndarray, np.ndarray]:
        least = np.array([_function(_short(self.shingles[i]), f).min() for i in group], np.uint32)
        order = np.argsort(least, kind="stable")
        return least[order], np.array(group)[order]


def _window_minima(widths: dict[int, int], grams: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Partition, function, and the minima of its windows, with the text of each window and its number in the text. ``widths``: blocks of a window."""
    lengths = np.diff(at)
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    inside = np.arange(len(owner)) - np.repeat(A.offsets(blocks)[:-1], blocks)
    begin = at[:-1][owner] + inside * BLOCK
    x = _short(grams)
    ends: dict[int, np.ndarray] = {}
    for f in range(FUNCTIONS if len(grams) else 0):
        low = np.minimum.reduceat(_function(x, f), begin)
        wide, reach = {1: low}, 1
        for part, width in sorted(widths.items(), key=lambda p: p[1]):
            while reach * 2 <= width:
                wide[reach * 2] = _joined(wide[reach], reach, owner, ends)
                reach *= 2
            yield part, f, wide[reach] if reach == width else np.minimum(wide[reach], _shifted(wide[reach], width - reach, owner, ends)), owner, inside


def _candidates(items: Items, grams: np.ndarray, at: np.ndarray) -> set[tuple[int, int, int]]:
    """(text, item, first word of the window) wherever a window of the shingles has a minimum in common with an item."""
    found: set[tuple[int, int, int]] = set()
    flags = np.zeros(1 << 16, bool)
    for part, f, span, owner, inside in _window_minima(dict(enumerate(items.widths)), grams, at):
        values, which = items.minima[part][f]
        flags[values & np.uint32(0xFFFF)] = True
        hit = np.flatnonzero(flags[span & np.uint32(0xFFFF)])
        flags[values & np.uint32(0xFFFF)] = False
        if len(hit):
            a, b = np.searchsorted(values, span[hit], "left"), np.searchsorted(values, span[hit], "right")
            for k in np.flatnonzero(b > a):
                w = hit[k]
                found.update((int(owner[w]), int(i), int(inside[w]) * BLOCK) for i in which[a[k] : b[k]])
    return found


def _exact(items: Items, k: int, grams: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, item, place in the text) of every string of ``k`` words that a text has in common with a short item."""
    values, which = items.exact[k]
    flags = np.zeros(1 << 16, bool)
    flags[values & np.uint64(0xFFFF)] = True
    hit = np.flatnonzero(flags[grams & np.uint64(0xFFFF)])
    a, b = np.searchsorted(values, grams[hit], "left"), np.searchsorted(values, grams[hit], "right")
    for x in np.flatnonzero(b > a):
        doc = int(np.searchsorted(at, hit[x], "right")) - 1
        for item in which[a[x] : b[x]]:
            yield doc, item, int(hit[x] - at[doc])


def _shifted(low: np.ndarray, by: int, owner: np.ndarray, same: dict[int, np.ndarray]) -> np.ndarray:
    out = np.full(len(low), NONE, np.uint32)
    if by < len(low):
        if by not in same:
            same[by] = owner[by:] == owner[:-by]
        out[:-by] = np.where(same[by], low[by:], NONE)
    return out


def _joined(low: np.ndarray, by: int, owner: np.ndarray, same: dict[int, np.ndarray]) -> np.ndarray:
    return np.minimum(low, _shifted(low, by, owner, same))


def _shared(own: np.ndarray, grams: np.ndarray) -> int:
    """How many of an item's sorted shingles are among the given ones."""
    place = np.searchsorted(own, grams)
    place[place == len(own)] = 0
    return int(np.bincount(place[own[place] == grams], minlength=1).astype(bool).sum())


def longest_run(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The longest run of item words that stands in the text, in order and with at most one word in WRONG wrong: its words, and the right ones among them.

    A run keeps its offset between item and text; in items that are not short, but for one word more or less."""
    i, j = np.nonzero(item[:, None] == text[None, :])
    if not len(i):
        return 0, 0
    n, best = len(item), (0, 0)
    shift = j - i
    tally = np.bincount(shift + n)
    near, slack = tally.copy(), int(n >= EXACT)
    if slack:
        near[1:] += tally[:-1]
        near[:-1] += tally[1:]
    for d in np.flatnonzero(near >= max(1, 0.25 * n)):
        match = np.zeros(n, bool)
        match[i[np.abs(shift + n - d) <= slack]] = True
        # words a to b are a run if the scores up to b come to what they were at a; the first of the least and the last of the greatest scores bound it
        s = np.concatenate([[0], np.cumsum(np.where(match, 1, 1 - WRONG))])
        top = np.maximum.accumulate(s[::-1])[::-1]
        a = np.flatnonzero(np.concatenate([[True], s[1:] < np.minimum.accumulate(s)[:-1]]))
        b = np.searchsorted(-top, -s[a], "right") - 1
        k = int((b - a).argmax())
        run = (int(b[k] - a[k]), int(match[a[k] : b[k]].sum()))
        best = max(best, run)
    return best


def _verified(item: np.ndarray, shingles: np.ndarray, text: np.ndarray, grams: np.ndarray) -> tuple[int, int] | None:
    """Run and right words of an item in a piece of text, if it is a case."""
    n = len(item)
    if n >= EXACT and _shared(shingles, grams) < n / 4 - 2:
        return None
    run = longest_run(item, text)
    return run if 2 * run[0] >= n else None


def _around(first: int, n: int) -> tuple[int, int]:
    """The words of a text in which an item of n words stands that has to do with the window that begins at ``first``."""
    return max(0, first - n), first + 3 * n + BLOCK


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows: dict[tuple[int, int], tuple[int, int]] = {}
            for a, b in A.slices(texts):
                hashes, bounds = words(texts[a:b])
                grams, at = A.ngrams(hashes, bounds, SHINGLE)
                found = _candidates(items, grams, at) if items.parts else set()
                for k in items.exact:
                    strings, begins = (grams, at) if k == SHINGLE else A.ngrams(hashes, bounds, k)
                    found.update((doc, item, place // BLOCK * BLOCK) for doc, item, place in _exact(items, k, strings, begins))
                for doc, item, first in found:
                    own = items.words[item]
                    begin, end = _around(first, len(own))
                    got = _verified(own, items.shingles[item], hashes[bounds[doc] + begin : min(bounds[doc] + end, bounds[doc + 1])], grams[at[doc] + begin : min(at[doc] + end, at[doc + 1])])
                    if got:
                        rows[a + doc, item] = max(rows.get((a + doc, item), (0, 0)), got)
            keys = list(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([d for d, _ in keys], pa.int64())),
                    pa.array([items.ids[i] for _, i in keys], pa.int64()),
                    pa.array([rows[k][1] for k in keys], pa.int32()),
                    pa.array([rows[k][0] for k in keys], pa.int32()),
                    pa.array([len(items.words[i]) for _, i in keys], pa.int32()),
                ],
                names=["doc_id", "item_id", "matched_words", "run_words", "item_words"],
            )

    return run


SCHEMA = "doc_id bigint, item_id bigint, matched_words int, run_words int, item_words int"


def _few(corpus: DataFrame, rows: list) -> DataFrame:
    return corpus.mapInArrow(_search(Items([r.item_id for r in rows], [r.text for r in rows])), SCHEMA)


def _part(n: int) -> int:
    """The size partition of an item, on a fixed grid."""
    return int(np.log(n / EXACT) / np.log(STEP) + 1e-9)


def _key(part: int, f: int, values: np.ndarray) -> np.ndarray:
    """One number for a partition, a function and a minimum."""
    return A.mix(values.astype(np.uint64) | np.uint64((part * FUNCTIONS + f + 1) << 32))


def _gram_key(k: int, grams: np.ndarray) -> np.ndarray:
    """One number for a string of k words by which short items are looked up."""
    return A.mix(grams + np.uint64(k))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item its words, what it is looked up by (a size partition, or minus the words of its strings), and its keys."""
    for batch in batches:
        hashes, bounds = words([t or "" for t in batch.column(1).to_pylist()])
        rows = []
        for i, item in enumerate(batch.column(0).to_pylist()):
            own = hashes[bounds[i] : bounds[i + 1]]
            n = len(own)
            if 0 < n < EXACT:
                kind = -looked_up(n)
                keys = _gram_key(-kind, np.unique(A.ngrams(own, np.array([0, n]), -kind)[0]))
            elif n:
                kind = _part(n)
                x = _short(np.unique(A.ngrams(own, np.array([0, n]), SHINGLE)[0]))
                keys = np.concatenate([_key(kind, f, _function(x, f).min(keepdims=True)) for f in range(FUNCTIONS)])
            else:
                continue
            rows.append((item, n, kind, own.view(np.int64), keys.view(np.int64)))
        cols = list(zip(*rows)) if rows else [[] for _ in range(5)]
        long = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], long), pa.array(cols[4], long)], names=["item_id", "n", "kind", "item", "keys"])


def _scan(sent, widths: dict[int, int], strings: list[int]):
    """doc_id, key, first: windows and strings of the texts whose key the bitmap lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in A.slices(texts):
                hashes, bounds = words(texts[a:b])
                grams, at = A.ngrams(hashes, bounds, SHINGLE)
                for part, f, span, owner, inside in _window_minima(widths, grams, at):
                    keys = _key(part, f, span)
                    if len(hit := bitmap.passed(flags, keys)):
                        yield _hits(batch, a + owner[hit], keys[hit], inside[hit] * BLOCK)
                for k in strings:
                    found, begins = (grams, at) if k == SHINGLE else A.ngrams(hashes, bounds, k)
                    keys = _gram_key(k, found)
                    if len(hit := bitmap.passed(flags, keys)):
                        doc = np.searchsorted(begins, hit, "right") - 1
                        yield _hits(batch, a + doc, keys[hit], (hit - begins[doc]) // BLOCK * BLOCK)

    return run


def _hits(batch: pa.RecordBatch, rows: np.ndarray, keys: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(keys.view(np.int64)), pa.array(first, pa.int64())], names=["doc_id", "key", "first"])


def _pieces(longest: int):
    """doc_id, piece, begin, text: the words of a text in overlapping pieces, each with all that windows beginning in it need."""
    step = 4 * longest + BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in A.slices(texts):
                hashes, bounds = words(texts[a:b])
                rows = [(d, p, max(0, p * step - longest)) for d in range(b - a) for p in range(-(-int(bounds[d + 1] - bounds[d]) // step))]
                parts = [hashes[bounds[d] + first : min(bounds[d] + (p + 1) * step + 3 * longest + BLOCK, bounds[d + 1])].view(np.int64) for d, p, first in rows]
                cols = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([a + d for d in cols[0]], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["doc_id", "piece", "begin", "text"]
                )

    return run, step


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = []
        for at, (begin, first) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            text, own = (np.asarray(batch.column(c)[at].values).view(np.uint64) for c in (4, 5))
            a, b = _around(first, len(own))
            text = text[a - begin : b - begin]
            shingles, grams = (A.ngrams(x, np.array([0, len(x)]), SHINGLE)[0] for x in (own, text))
            if found := _verified(own, np.unique(shingles), text, grams):
                got.append((at, found[1], found[0], len(own)))
        cols = list(zip(*got)) if got else [[] for _ in range(4)]
        rows = pa.array(cols[0], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["doc_id", "item_id", "matched_words", "run_words", "item_words"])


def _many(corpus: DataFrame, asked: DataFrame) -> DataFrame:
    """Any number of items, in one search of the corpus; only a bitmap and the sizes of the partitions reach the driver."""
    spark = corpus.sparkSession
    stages = Stages(spark)
    index = stages.put(asked.mapInArrow(_indexed, "item_id bigint, n int, kind int, item array<bigint>, keys array<bigint>"))
    keyed = index.select("item_id", F.explode("keys").alias("key"))
    kinds = {r.kind: r.n for r in index.groupBy("kind").agg(F.max("n").alias("n")).collect()}  # as many as powers of STEP up to the longest item
    flags = bitmap.build(keyed.select("key"), int(index.agg(F.sum(F.size("keys"))).first()[0] or 0))
    widths = {k: -(-n // BLOCK) + 1 for k, n in kinds.items() if k >= 0}
    hits = corpus.mapInArrow(_scan(spark.sparkContext.broadcast(flags), widths, [-k for k in kinds if k < 0]), "doc_id bigint, key bigint, first bigint")
    found = stages.put(hits.join(keyed, "key").select("doc_id", "item_id", "first").distinct())
    longest = max(kinds.values(), default=1)
    cut, step = _pieces(longest)
    needed = stages.put(found.select("doc_id").distinct())
    texts = corpus.join(broadcast_if(needed, needed.count(), FEW_IDS), "doc_id", "left_semi").mapInArrow(cut, "doc_id bigint, piece bigint, begin bigint, text array<bigint>")
    rows = found.withColumn("piece", F.floor(F.col("first") / step)).join(texts, ["doc_id", "piece"]).join(index.select("item_id", "item"), "item_id")
    return rows.select("doc_id", "item_id", "begin", "first", "text", "item").mapInArrow(_judged, SCHEMA)


#: Rows of ids that may be broadcast; more are shuffled.
FEW_IDS = 200_000


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", few: int = ITEMS) -> DataFrame:
    """doc_id, item_id, matched_words, run_words, item_words: every document with a passage of an item, each pair once."""
    corpus = docs.select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    asked = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    rows = asked.orderBy("item_id").limit(few + 1).collect()
    out = _few(corpus, rows) if len(rows) <= few else _many(corpus, asked)
    return out.groupBy("doc_id", "item_id").agg(F.max("matched_words").alias("matched_words"), F.max("run_words").alias("run_words"), F.max("item_words").alias("item_words"))
