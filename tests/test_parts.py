"""Pairs from parts of shingle sets, against every pair compared."""

import random

import numpy as np

from lexmill.operators import near, parts

WORDS = [a + b + c for a in ("ka", "so", "mi") for b in ("lu", "ner", "ti") for c in ("da", "xo")]


def texts():
    rng = random.Random(4)
    made = [" ".join(rng.choices(WORDS, k=rng.choice((2, 10, 30, 60, 200)))) for _ in range(250)]
    for t in made[:60]:  # copies with words changed, or with some more
        words = t.split()
        for i in rng.sample(range(len(words)), rng.randrange(1, 3)):
            words[i] = "".join(rng.choices("qwrtzp", k=4))
        made += [" ".join(words), t + " " + " ".join(rng.choices(WORDS, k=len(words) // rng.choice((6, 9))))]
    return [*made, made[0] + "\n", "", "abc", "abc ", "abcde", None]


def table(spark, made):
    return spark.createDataFrame([(i, t) for i, t in enumerate(made)], "row_index bigint, text string")


def every(made, threshold):
    sets = [set(s.tolist()) for s in near._shingles([t or "" for t in made])]
    out = {}
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a and b and len(a & b) / len(a | b) >= threshold and min(len(made[i]), len(made[j])) / max(len(made[i]), len(made[j])) >= threshold:
                out[i, j] = round(len(a & b) / len(a | b), 9)
    return out


def test_every_pair_is_found(spark):
    made = texts()
    for threshold in (0.8, 0.6, 0.95):
        got = near.exact_edges(table(spark, made), threshold).collect()
        assert len(got) == len({(r.l, r.r) for r in got})
        assert {(r.l, r.r): round(r.similarity, 9) for r in got} == every(made, threshold) != {}


def test_parts_are_rows_of_batches(spark, monkeypatch):
    """Few shingles that all texts share: neither shingles nor pairs that are far from similar are written as rows."""
    written, put = [], near.Stages.put
    monkeypatch.setattr(near.Stages, "put", lambda self, df, files=None: (written.append(0), out := put(self, df, files), written.append(out.count()))[1])
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    made = [" ".join(rng.choices(words, k=100)) for _ in range(200)]
    made += [t + " and some more" for t in made[:20]]
    assert near.exact_edges(table(spark, made), 0.8).count() == 20
    assert max(written) < 10 * len(made)  # a row for each shingle would be hundreds for each text


def test_sets_that_ask_for_less_rare_parts_send_the_rare_ones(monkeypatch):
    """Whatever the weights, sets that differ in as many members as they may have MATCHES equal parts in one range."""
    rng = np.random.default_rng(5)
    for n, gone, come in ((5, 0, 1), (60, 6, 6), (400, 44, 44), (400, 0, 100), (3000, 333, 333)):
        h = rng.integers(0, 2**63, n + come, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(h[:n]), np.sort(h[gone:])
        b_home = parts.bounds(0.8, len(b))
        top = int(b_home[np.searchsorted(b_home, len(b), side="right")]) - 1
        ranges, count = parts.level_of(0.8, top)
        sent = []
        for s in (a, b):
            needed = parts.differing(0.8, len(s) + min(top, int(len(s) / 0.8))) + ranges * (parts.MATCHES - 1) + 1
            digest, use = parts.digests(s, np.array([len(s)]), (s >> np.uint64(9)).astype(np.int64) % 200 + 1, count, np.array([needed]))
            sent.append(np.where(use[0], digest[0].astype(np.int64), -1 - len(sent)))
        equal = sent[0] == sent[1]
        assert max(equal[r::ranges].sum() for r in range(ranges)) >= parts.MATCHES
