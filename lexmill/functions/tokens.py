"""Token counts of whole texts under existing tokenizers, each distinct word tokenized once for each worker.

A tokenizer that never joins characters across a space gives a text the sum of its words' counts. So counts of
words are kept (up to ``KEPT`` of them, then begun anew), and a text costs a look-up for each word.
"""

from __future__ import annotations

import base64
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT = 1_000_000


class _Kept(dict):
    def __init__(self, count: Callable[[str], int]):
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(self) >= KEPT:
            self.clear()
        self[word] = n
        return n


class PieceCounter:
    """Best segmentation into pieces with scores (unigram model): NFC, split at white space, ▁ before each word,
    characters that no piece has become one unknown token for each run."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0):
        self.pieces, self.unknown = pieces, unknown
        self.kept: _Kept | None = None

    def __getstate__(self):
        return {"pieces": self.pieces, "unknown": self.unknown, "kept": None}

    def _open(self) -> _Kept:
        score = {p: s for i, (p, s) in enumerate(self.pieces) if i != self.unknown and p}
        longest = max(map(len, score), default=1)
        bad = min(score.values(), default=0.0) - 10

        def count(word: str) -> int:
            w = "▁" + word
            best: list[tuple[float, int, bool]] = [(0.0, 0, False)] + [(-math.inf, 0, False)] * len(w)  # score, tokens and unknown ones, in an unknown run
            for i in range(len(w)):
                here, n, lost = best[i]
                single = False
                for j in range(i + 1, min(len(w), i + longest) + 1):
                    s = score.get(w[i:j])
                    if s is not None:
                        single |= j == i + 1
                        if here + s > best[j][0]:
                            best[j] = (here + s, n + 1, False)
                if not single and here + bad > best[i + 1][0]:
                    best[i + 1] = (here + bad, n if lost else n + 1 + (1 << 32), True)
            return best[-1][1]

        return _Kept(count)

    def both(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens, and unknown ones among them; a word's two counts are kept as one number."""
        if self.kept is None:
            self.kept = self._open()
        look = self.kept.__getitem__
        n = np.fromiter((sum(map(look, unicodedata.normalize("NFC", t).split())) for t in texts), np.int64, len(texts))
        return n & 0xFFFFFFFF, n >> 32

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.both(texts)[0]


class ByteCounter:
    """Tokens of a byte-level BPE vocabulary of ranks. Its file is read where the counter is made, on the driver, and goes to the
    executors with it. Chunks end where a space follows another character, which is always a boundary of its pattern."""

    chunk = re.compile(r" *[^ ]+| +")

    def __init__(self, path: str, pattern: str):
        self.data, self.pattern = Path(path).read_bytes(), pattern
        self.kept: _Kept | None = None

    def __getstate__(self):
        return {"data": self.data, "pattern": self.pattern, "kept": None}

    def encoding(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.kept is None:
            encode = self.encoding().encode_ordinary
            self.kept = _Kept(lambda chunk: len(encode(chunk)))
        look, cut = self.kept.__getitem__, self.chunk.findall
        return np.fromiter((sum(map(look, cut(t))) for t in texts), np.int64, len(texts))


def counted(rows: DataFrame, key: str, text: str, counter) -> DataFrame:
    """key, tokens: rows with a null text have 0."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = counter([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=[key, "tokens"])

    return rows.select(key, F.col(text)).mapInArrow(run, f"{key} {kind}, tokens bigint")


class PieceEncoder:
    """Ids of the same segmentation: pieces are (piece, score, id); characters that no piece has become one unknown id for each run."""

    def __init__(self, pieces: list[tuple[str, float, int]], unknown: int = 0):
        self.pieces, self.unknown = pieces, unknown
        self.kept: _Kept | None = None

    def __getstate__(self):
        return {"pieces": self.pieces, "unknown": self.unknown, "kept": None}

    def _open(self) -> _Kept:
        table = {p: (s, n) for p, s, n in self.pieces if p}
        longest = max(map(len, table), default=1)
        bad = min((s for s, _ in table.values()), default=0.0) - 10

        def encode(word: str) -> tuple[int, ...]:
            w = "▁" + word
            n = len(w)
            score, lost = [0.0] + [-math.inf] * n, [False] * (n + 1)
            back: list[tuple[int, int | None]] = [(0, None)] * (n + 1)  # where the last token begins, and its id; None goes on with an unknown run
            for i in range(n):
                single = False
                for j in range(i + 1, min(n, i + longest) + 1):
                    if (hit := table.get(w[i:j])) is not None:
                        single |= j == i + 1
                        if score[i] + hit[0] > score[j]:
                            score[j], back[j], lost[j] = score[i] + hit[0], (i, hit[1]), False
                if not single and score[i] + bad > score[i + 1]:
                    score[i + 1], back[i + 1], lost[i + 1] = score[i] + bad, (i, None if lost[i] else self.unknown), True
            out = []
            while n:
                n, token = back[n]
                if token is not None:
                    out.append(token)
            return tuple(reversed(out))

        return _Kept(encode)

    def words(self, words: list[str]) -> list[tuple[int, ...]]:
        if self.kept is None:
            self.kept = self._open()
        return [self.kept[w] for w in words]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.fromiter(chain.from_iterable(self.words(unicodedata.normalize("NFC", t).split())), np.int32) for t in texts]


def encoded_ids(rows: DataFrame, key: str, text: str, encoder: PieceEncoder, end: int | None = None) -> DataFrame:
    """key, ids: the token ids of each text, with the end mark if given; null texts have none but it."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encoder([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    out = rows.select(key, F.col(text)).mapInArrow(run, f"{key} {kind}, ids array<int>")
    return out if end is None else out.withColumn("ids", F.array_append("ids", F.lit(end)))


#: Pieces of a vocabulary; a larger table is no vocabulary.
PIECES = 1_000_000


def piece_counter(pieces: DataFrame) -> PieceCounter:
    """A counter of a table piece_id, piece, score, in which 0 is unknown and 1 the end mark."""
    rows = pieces.where("piece is not null and score is not null").orderBy("piece_id").limit(PIECES + 1).select("piece_id", "piece", "score").collect()
    if len(rows) > PIECES:
        raise ValueError(f"a vocabulary has at most {PIECES} pieces")
    unknown = next((i for i, r in enumerate(rows) if r.piece_id == 0), 0)
    return PieceCounter([("" if r.piece_id == 1 else r.piece, r.score) for r in rows], unknown)


def piece_encoder(pieces: DataFrame) -> PieceEncoder:
    """The encoder of the same table."""
    rows = pieces.where("piece is not null and score is not null and piece_id > 1").orderBy("piece_id").limit(PIECES + 1).select("piece", "score", "piece_id").collect()
    if len(rows) > PIECES:
        raise ValueError(f"a vocabulary has at most {PIECES} pieces")
    return PieceEncoder([tuple(r) for r in rows])


def encoded(rows: DataFrame, key: str, text: str, counter: PieceCounter) -> DataFrame:
    """key, token_count (with the end mark), unknown_tokens."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lost = counter.both([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n + 1), pa.array(lost)], names=[key, "token_count", "unknown_tokens"])

    return rows.select(key, F.col(text)).mapInArrow(run, f"{key} {kind}, token_count bigint, unknown_tokens bigint")
