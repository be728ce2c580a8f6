"""Matches of parts in one range of a level, against every pair; normalization against its patterns taken one after the other."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import parts

LEVEL, T = 15, 0.8


def rows(digests, sizes):
    facts = np.array([[len(d) for d in digests], sizes], np.int32).tobytes()
    raw = np.concatenate(digests).astype("<u4").view(np.uint8).reshape(-1, 4)[:, : parts.DIGEST].tobytes()
    return pa.table({"level": pa.array([LEVEL], pa.int32()), "ids": pa.array([list(range(len(sizes)))]), "facts": pa.array([facts], pa.binary()), "digests": pa.array([raw], pa.binary())})


def made(seed, count, kinds):
    """Sets of both classes of the level, each with 6 digests of few kinds."""
    rng, b = np.random.default_rng(seed), parts.bounds(T, 1000)
    return [rng.choice(kinds, 6, replace=False) for _ in range(count)], rng.integers(b[LEVEL - 1], b[LEVEL + 1], count)


def every(digests, sizes):
    own, out = parts.bounds(T, 1000)[LEVEL], set()
    for j in range(len(sizes)):
        for i in range(j):
            small, large = sorted((sizes[i], sizes[j]))
            if large >= own and small >= T * large and len(np.intersect1d(digests[i], digests[j])) >= parts.MATCHES:
                out.add((i, j))
    return out


def test_matches_are_those_of_every_pair(monkeypatch):
    digests, sizes = made(1, 150, 20)
    digests[3], sizes[3] = digests[2], sizes[2]
    for chunk in (parts.CHUNK, 50):
        monkeypatch.setattr(parts, "CHUNK", chunk)
        got = parts._met(T)(rows(digests, sizes))
        pairs = list(zip(got["l"].to_pylist(), got["r"].to_pylist()))
        assert len(pairs) == len(set(pairs)) and set(pairs) == every(digests, sizes) != set()
    assert parts._met(T)(rows([np.array([7 * i]) for i in range(5)], sizes[:5])).num_rows == 0


def test_memory_of_a_group_does_not_follow_its_matches():
    """7 197 952 matches of 4000 sets: 462 MB when all were made and then compared, 44 MB since."""
    digests, sizes = made(2, 4000, 20)
    digests = [d + 20 * (i % 2) for i, d in enumerate(digests)]
    given = rows(digests, sizes)
    tracemalloc.start()
    parts._met(T)(given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_normalization_is_that_of_its_patterns(spark):
    rng = random.Random(3)
    pieces = ["a", "ə", "É", "1", ".", " ", " ", "  ", "\t", "\n", "\n", "\r", "\r\n", "\0", "\x0b", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", " ", " ", "　", "​", "😀"]
    df = spark.createDataFrame([("".join(rng.choices(pieces, k=rng.randrange(25))),) for _ in range(4000)], "text string")
    for name, c in text.normalized(F.col("text")).items():
        df = df.withColumn(name, c)
    blanks = F.regexp_replace("n3", rf"[\x{{9}}\x{{20}}{text.WIDE_SPACE}]+", " ")
    plain = {
        "n2": F.regexp_replace("n1", r"\r\n?", "\n"), "n4": F.regexp_replace(blanks, r"(?dm)^ +| +$", ""), "n5": F.regexp_replace("n4", "\n{3,}", "\n\n"),
        "clean": F.regexp_replace("n5", r"^\s+|\s+$", ""),
    }
    assert df.select([F.count_if(~F.col(k).eqNullSafe(c)) for k, c in plain.items()]).first() == (0, 0, 0, 0)
