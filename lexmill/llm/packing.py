"""Texts into training sequences of fixed capacity (problem 8), by sum-of-squares online packing.

Texts are sized in tokens of a public tokenizer and dealt by a hash into packing groups of about ``GROUP`` texts,
which are packed each by itself: only ids and sizes are shuffled. In a group, ``level[h]`` is the number of open
sequences filled to h; a text of size s goes to the level h for which the sum of squares of all levels comes out
least (a new sequence being level 0), the fullest of equal ones. A text over the capacity is cut: full
sequences of its own, and a rest that is placed like a text.

Defined results: texts of no tokens (null, empty) have one row with a null sequence; rows without id are left
out; repeated rows of an id are one text; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.budget import document_tokens

CAPACITY, GROUP = 2048, 50_000


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item, in order; sizes from 1 to capacity."""
    level = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity)]
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    far = np.int64(1) << 60
    for k, s in enumerate(sizes):
        # half the change of the sum of squares, doubled: full sequences no longer count
        change = 2 * (level[s:] - level[: capacity + 1 - s]) + 2
        change[-1] = 1 - 2 * level[capacity - s]
        change[1:][level[1 : capacity + 1 - s] == 0] = far
        change[0] = 2 * level[s] + 1 if s < capacity else 0
        h = len(change) - 1 - int(change[::-1].argmin())
        if h:
            own = open_[h].pop()
            level[h] -= 1
        else:
            own, made = made, made + 1
        sequence[k], offset[k] = own, h
        if h + s < capacity:
            open_[h + s].append(own)
            level[h + s] += 1
    return sequence, offset


def _packer(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "id"], kind="stable")
        n = group.tokens.to_numpy()
        parts = np.maximum(-(-n // capacity), 1)
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(parts)[:-1]]), parts)
        size = np.minimum(n[row] - part * capacity, capacity)
        some = size > 0
        at = pd.array([pd.NA] * len(row), dtype="Int64")
        start = np.zeros(len(row), np.int64)
        if some.any():
            own, start[some] = pack(size[some], capacity)
            at[some] = own + (int(group.g.iloc[0]) << 40)
        return pd.DataFrame({"doc_id": group.id.to_numpy()[row], "part": part.astype(np.int32), "sequence_id": at, "start": start, "tokens": size})

    return run


def sequences(docs: DataFrame, counter, capacity: int = CAPACITY, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, sequence_id, start, tokens: where each text, or each part of a text over the capacity, stands."""
    sized = document_tokens(docs, counter, id_col, text_col)
    groups = max(1, -(-docs.count() // group))
    keyed = sized.withColumn("h", F.xxhash64("id", F.lit(8))).withColumn("g", F.pmod("h", F.lit(groups)))
    return keyed.groupBy("g").applyInPandas(_packer(capacity), "doc_id bigint, part int, sequence_id bigint, start bigint, tokens bigint")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequences, tokens, capacity, unused_share of a packing."""
    per = packed.where("sequence_id is not null").groupBy("sequence_id").agg(F.sum("tokens").alias("n"))
    return per.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).select(
        "sequences", "tokens", F.lit(capacity).alias("capacity"), (1 - F.col("tokens") / F.greatest(F.col("sequences") * capacity, F.lit(1))).alias("unused_share")
    )


def check(packed: DataFrame, sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: texts placed, parts that reach over the capacity, parts that overlap in a sequence, texts cut that fit, texts whose tokens do not add up."""
    after = F.lead("start").over(Window.partitionBy("sequence_id").orderBy("start", F.desc("tokens")))
    parts = packed.withColumn("after", F.when(F.col("sequence_id").isNotNull(), after))
    own = parts.groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("parts"), F.count_if(F.col("start") + F.col("tokens") > capacity).alias("over"), F.count_if(F.col("start") + F.col("tokens") > F.col("after")).alias("overlapping"))
    each = own.join(sized.select(F.col("id").alias("doc_id"), F.col("tokens").alias("size")), "doc_id", "full")
    wrong = F.count_if(~F.col("placed").eqNullSafe(F.col("size")))
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return each.agg(F.count("*").alias("texts"), zero("over", "over_capacity"), zero("overlapping", "overlapping"), F.count_if((F.col("parts") > 1) & (F.col("size") <= capacity)).alias("cut_but_fitting"), wrong.alias("wrong_totals"))
