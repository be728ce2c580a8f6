"""Languages of documents and of their passages, by multilingual mixture inference (problem 10).

Each language has a multinomial over hashed 4-character strings of its lower-case words, fitted on at most
``SAMPLE`` labelled documents a language (the least hashes of their ids, so the sample is the same in every
run); documents whose first-round verdict contradicts their label are left out of the second round.
Azerbaijani typed without its marks has a distribution of its own, from the same texts stripped of marks.

A document is a mixture of the languages: runs of ``RUN`` words have a likelihood under each, and
expectation-maximisation gives the proportions. From all languages the least is dropped as long as that
lowers the log-likelihood by less than ``PENALTY`` x log(runs): what stays is the document's language set.
Where more than one stays, the best path over the words, with a price for each change, gives the passages.

Defined results: null, empty and letterless texts have no language (lang null, confidence 0) and are never a
case; ids may repeat, each row is judged by itself and the results are made distinct; a label that names no
known language counts as missing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import arrays as A
from lexmill.session import Stages

LANGS = ("az", "tr", "ru", "en")
#: Labelled documents a language that the model is fitted on.
SAMPLE = 1500
BITS, GRAM, RUN, ROUNDS = 20, 4, 4, 12
PENALTY, CHANGE = 6.0, 14.0
#: A language counts in a document if it holds this share of the letters.
SHARE = 0.2

# Names of the languages as labels spell them, besides the codes with regions and scripts.
NAMES = {
    "az": ["az", "aze", "azj", "azb", "azerbaijani", "azeri", "azərbaycan", "azərbaycanca", "azerbaycan", "azerbaycanca"],
    "tr": ["tr", "tur", "turkish", "türkçe", "turkce", "türk"],
    "ru": ["ru", "rus", "russian", "русский", "rusca"],
    "en": ["en", "eng", "english", "ingilis", "ingiliscə"],
}
# Azerbaijani letters and what is typed for them without marks.
MARKED, UNMARKED = "əıöüşçğƏİÖÜŞÇĞ", "eiouscgEIOUSCG"


def language_of(label: Column) -> Column:
    """The language that a label names, in whatever spelling; null if none."""
    name = F.element_at(F.split(F.lower(F.trim(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))), r"[-_\s(,;/.]"), 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(name.isin(names), lang).otherwise(out)
    return out


def _lower_table() -> np.ndarray:
    """Lower-case letter of each code point, 0 for what is no letter; combining marks stay, so that decomposed letters stay words."""
    if "lower" not in A._tables:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x30000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0]) if c != "İ" else ord("i")
        A._tables["lower"] = table
    return A._tables["lower"]


@dataclass
class Words:
    """Words of a slice of texts: bins of the strings ending in each letter, and where words and texts start."""

    bins: np.ndarray
    word_start: np.ndarray
    letters: np.ndarray
    bounds: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def cut(texts: list[str]) -> Words:
    """Only letters count; each word is read with one space before it and one after the last letter."""
    cps, starts = A.points(texts)
    low = _lower_table()[cps]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = starts[:-1][starts[:-1] < len(low)]
    first[edge] = inside[edge]
    begin = np.flatnonzero(first)
    where = np.flatnonzero(inside)
    bounds = np.searchsorted(begin, starts)
    word = np.cumsum(first)[where] - 1
    letters = np.bincount(word, minlength=len(begin)).astype(np.int64)
    stream = np.zeros(len(where) + len(begin) + GRAM, np.uint32)
    place = np.arange(len(where)) + word + GRAM - 1
    stream[place] = low[where]
    h = np.zeros(len(where) + len(begin), np.uint64)
    for k in range(GRAM):
        h *= A.BASE
        h += stream[k + 1 : k + 1 + len(h)]
    bins = (A.mix(h) >> np.uint64(64 - BITS)).astype(np.int32)
    return Words(bins, np.arange(len(begin)) + A.offsets(letters)[:-1], letters, bounds, begin, begin + letters)


class Model:
    """log-probabilities [bin, language] from counts [language, bin]; the last language is Azerbaijani without marks."""

    def __init__(self, counts: np.ndarray):
        total = counts.sum(axis=1, keepdims=True)
        rest = 0.02 * counts.sum(axis=0) / max(1.0, counts.sum()) + 1e-8
        self.table = np.log((counts / np.maximum(total, 1) * 0.98) + rest).T.astype(np.float32).copy()

    def scores(self, w: Words) -> np.ndarray:
        """log-likelihood [word, language]."""
        if not len(w.word_start):
            return np.zeros((0, self.table.shape[1]))
        return np.add.reduceat(self.table[w.bins], w.word_start, axis=0).astype(np.float64)

    def documents(self, texts: list[str]) -> np.ndarray:
        """The likeliest language of each text."""
        own = []
        for a, b in A.slices(texts):
            w = cut(texts[a:b])
            total = A.sums(self.scores(w), w.bounds)
            total[:, 0] = np.maximum(total[:, 0], total[:, -1])
            own.append(total[:, : len(LANGS)].argmax(axis=1))
        return np.concatenate(own)


def runs(scores: np.ndarray, letters: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores and letters of runs of RUN words inside each text, and where each text's runs start."""
    n = np.diff(bounds)
    per = -(-n // RUN)
    at = A.offsets(per)
    owner = np.repeat(np.arange(len(n)), per)
    start = bounds[:-1][owner] + (np.arange(len(owner)) - at[:-1][owner]) * RUN
    if not len(start):
        return np.zeros((0, scores.shape[1])), np.zeros(0), at
    return np.add.reduceat(scores, start, axis=0), np.add.reduceat(letters, start).astype(float), at


def mixture(scores: np.ndarray, weight: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [text, language] of the chosen language sets, and the posterior of each run."""
    docs, k = len(at) - 1, scores.shape[1]
    owner = np.repeat(np.arange(docs), np.diff(at))
    like = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    total = np.maximum(A.sums(weight[:, None], at), 1e-9)

    def fit(allowed: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pick = some[owner]
        l, own, w = like[pick], owner[pick], weight[pick]
        part = A.offsets(np.where(some, np.diff(at), 0))
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            post = pi[own] * l
            post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
            pi = np.where(some[:, None], A.sums(post * w[:, None], part) / total, pi)
        loglik = A.sums(np.log(np.maximum((pi[own] * l).sum(axis=1, keepdims=True), 1e-300)), part)[:, 0]
        return pi, loglik

    allowed = np.ones((docs, k))
    some = np.diff(at) > 0
    pi, best = fit(allowed, some)
    price = PENALTY * np.log(np.maximum(np.diff(at), 2))
    for _ in range(k - 1):
        size = allowed.sum(axis=1)
        try_ = some & (size > 1)
        if not try_.any():
            break
        least = np.where(allowed > 0, pi, np.inf).argmin(axis=1)
        smaller = allowed.copy()
        smaller[np.arange(docs)[try_], least[try_]] = 0
        pi2, got = fit(smaller, try_)
        better = try_ & (best - got < price)
        allowed[better], pi[better], best[better] = smaller[better], pi2[better], got[better]
        some = better
    post = pi[owner] * like
    post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300) if len(post) else 1
    return np.where(np.diff(at)[:, None] > 0, pi, 0), post


def path(scores: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Best language of each word among the allowed, with a price for each change."""
    use = np.flatnonzero(allowed)
    s = scores[:, use]
    back = np.zeros(s.shape, np.int8)
    now = s[0].copy()
    for i in range(1, len(s)):
        top = int(now.argmax())
        stay = now >= now[top] - CHANGE
        back[i] = np.where(stay, np.arange(len(use)), top)
        now = np.where(stay, now, now[top] - CHANGE) + s[i]
    out = np.empty(len(s), np.int64)
    out[-1] = now.argmax()
    for i in range(len(s) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return use[out]


def judge(model: Model, texts: list[str]) -> Iterator[tuple[int, int, list[tuple[int, int, int, int, float]], float]]:
    """For each text: its place, letters, passages (begin, end, language, letters, confidence) in order, and its confidence."""
    for a, b in A.slices(texts):
        w = cut(texts[a:b])
        scores = model.scores(w)
        run_scores, weight, at = runs(scores, w.letters, w.bounds)
        pi, post = mixture(run_scores, weight, at)
        _, starts = A.points(texts[a:b])
        merged = pi[:, : len(LANGS)].copy()
        merged[:, 0] += pi[:, -1]
        post[:, 0] += post[:, -1]
        for d in range(b - a):
            lo, hi = w.bounds[d], w.bounds[d + 1]
            if lo == hi:
                yield a + d, 0, [], 0.0
                continue
            letters = int(w.letters[lo:hi].sum())
            several = merged[d] > 0
            if several.sum() == 1:
                lang = int(merged[d].argmax())
                whole = _document(scores[lo:hi])
                sure = float(np.exp(whole[lang] - np.logaddexp.reduce(whole)))
                yield a + d, letters, [(int(w.begin[lo] - starts[d]), int(w.end[hi - 1] - starts[d]), lang, letters, sure)], sure
                continue
            langs = path(scores[lo:hi], pi[d] > 0)
            langs[langs == len(LANGS)] = 0
            edge = np.concatenate([[0], np.flatnonzero(langs[1:] != langs[:-1]) + 1, [hi - lo]])
            own = post[at[d] : at[d + 1], : len(LANGS)]
            out = []
            for s, e in zip(edge[:-1], edge[1:]):
                lang = int(langs[s])
                n = w.letters[lo + s : lo + e]
                sure = float((own[np.arange(s, e) // RUN, lang] * n).sum() / n.sum())
                out.append((int(w.begin[lo + s] - starts[d]), int(w.end[lo + e - 1] - starts[d]), lang, int(n.sum()), sure))
            yield a + d, letters, out, float(sum(x[4] * x[3] for x in out) / letters)


def _document(scores: np.ndarray) -> np.ndarray:
    total = scores.sum(axis=0)
    total[0] = np.logaddexp(total[0], total[-1])
    return total[: len(LANGS)]


PASSAGES = "id bigint, letters bigint, begin bigint, end bigint, lang string, passage_letters bigint, confidence double"


def _passages(model: Model):
    names = pa.array(LANGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [unicodedata.normalize("NFC", t or "") for t in batch.column(1).to_pylist()]
            rows = [(d, letters, *p) for d, letters, found, _ in judge(model, texts) for p in (found or [(0, 0, None, 0, 0.0)])]
            cols = list(zip(*rows)) if rows else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(cols[0], pa.int64())),
                    pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.int64()),
                    pa.array(cols[3], pa.int64()),
                    names.take(pa.array(cols[4], pa.int64())),
                    pa.array(cols[5], pa.int64()),
                    pa.array(cols[6], pa.float64()),
                ],
                names=["id", "letters", "begin", "end", "lang", "passage_letters", "confidence"],
            )

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model:
    """The model, from at most ``sample`` labelled documents of each language, those with the least hashes of their ids.

    Labels are counted first, so that one scan brings about two samples of each language, however many rows there are. The sample stays with
    the executors; the driver gets its counts of strings, at most one for each language and bin."""
    spark = docs.sparkSession
    label = language_of(F.col(label_col)).alias("label")
    have = {r.label: r.n for r in docs.select(label).where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    most = {lang: (1 << 63) * (2 * min(1.0, 2 * sample / n) - 1) for lang, n in have.items()}
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), label)
    rows = rows.where("text is not null and label is not null and length(text) >= 50").withColumn("h", F.xxhash64("id", F.lit(5)))
    near = F.lit(False)
    for lang, top in most.items():
        near = near | ((F.col("label") == lang) & (F.col("h") <= min(int(top), (1 << 63) - 1)))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "id", "text"))  # of about two samples of a language
    chosen = rows.where(near).withColumn("place", place).where(F.col("place") <= sample)
    chosen = Stages(spark).put(chosen.select(F.array_position(F.array(*map(F.lit, LANGS)), F.col("label")).cast("int").alias("k"), "text").repartition(spark.sparkContext.defaultParallelism))
    first = _counted(chosen, None)
    second = _counted(chosen, spark.sparkContext.broadcast(Model(first)))
    for lang in range(len(LANGS)):
        if not second[lang].any():  # no text of the language is taken for it: all of them stay
            second[lang] = first[lang]
            if lang == 0:
                second[-1] = first[-1]
    return Model(second)


def _counted(chosen: DataFrame, sent) -> np.ndarray:
    """How often each string stands in the sample of each language [language, bin]; with a model, in the texts that it takes for their language."""
    bare = str.maketrans(MARKED, UNMARKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(LANGS) + 1, 1 << BITS), np.int64)
        for batch in batches:
            labels = batch.column(0).to_numpy() - 1
            texts = [unicodedata.normalize("NFC", t) for t in batch.column(1).to_pylist()]
            keep = np.ones(len(texts), bool) if sent is None else sent.value.documents(texts) == labels if texts else np.zeros(0, bool)
            for lang in range(len(LANGS)):
                own = [t for t, x in zip(texts, keep & (labels == lang)) if x]
                for a, b in A.slices(own):
                    table[lang] += np.bincount(cut(own[a:b]).bins, minlength=1 << BITS)
                    if lang == 0:
                        table[-1] += np.bincount(cut([t.translate(bare) for t in own[a:b]]).bins, minlength=1 << BITS)
        k, at = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(table[k, at])], names=["k", "bin", "n"])

    got = chosen.mapInArrow(run, "k int, bin int, n bigint").groupBy("k", "bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(LANGS) + 1, 1 << BITS))
    out[got["k"].to_numpy(), got["bin"].to_numpy()] = got["n"].to_numpy()
    return out


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every passage of every text: id, letters of the text, begin and end in code points of its NFC form, lang,
    passage_letters, confidence. A text in one language is one passage; one without letters has a row with lang null."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        yield from _passages(sent.value)(batches)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PASSAGES)


def documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row for each document and language found in it: id, label_lang, letters, lang, share of the letters, confidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [unicodedata.normalize("NFC", t or "") for t in batch.column(1).to_pylist()]
            rows = []
            for d, letters, found, _ in judge(sent.value, texts):
                held: dict[int, list[float]] = {}
                for _, _, lang, n, sure in found:
                    own = held.setdefault(lang, [0, 0.0])
                    own[0] += n
                    own[1] += n * sure
                rows += [(d, letters, lang, n / letters, s / n) for lang, (n, s) in sorted(held.items())] or [(d, 0, None, 0.0, 0.0)]
            cols = list(zip(*rows)) if rows else [[] for _ in range(5)]
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(2).take(at),
                    pa.array(cols[1], pa.int64()),
                    pa.array(LANGS).take(pa.array(cols[2], pa.int64())),
                    pa.array(cols[3], pa.float64()),
                    pa.array(cols[4], pa.float64()),
                ],
                names=["id", "label_lang", "letters", "lang", "share", "confidence"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), language_of(F.col(label_col)).alias("label_lang"))
    return rows.mapInArrow(run, "id bigint, label_lang string, letters bigint, lang string, share double, confidence double")


def cases(judged: DataFrame, min_letters: int = 50) -> DataFrame:
    """doc_id, lang: documents with a missing or wrong label or with several languages, a row for each language
    that holds at least ``SHARE`` of the letters."""
    held = judged.where((F.col("letters") >= min_letters) & (F.col("share") >= SHARE) & F.col("id").isNotNull()).distinct()
    per = held.groupBy("id").agg(F.collect_set("lang").alias("langs"), F.max("label_lang").alias("label"))
    wrong = per.where((F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label")))
    return wrong.select(F.col("id").alias("doc_id"), F.explode("langs").alias("lang"))
