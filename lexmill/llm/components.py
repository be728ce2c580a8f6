"""Groups from pairwise matches (problem 3): strip, compress, solve the core, restore.

Each round of ``groups`` (a) strips vertices of degree one, layer by layer as long as that removes at least
a tenth of the edges, hanging each on its neighbour; (b) compresses chains of degree-two vertices by list
ranking: every directed edge into such a vertex points to the edge that leaves it on the other side, pointers
are doubled until they end outside the chain, and the chain becomes one edge between its ends (a closed chain
hangs on its least vertex). The rounds end when the core has no more than ``core_edges`` edges, which one task
solves by union-find, or no longer shrinks, when it is contracted by least neighbours. Labels then go back to
the removed vertices, the last removed first. Long chains and deep trees thus take a number of rounds that
grows with the logarithm of their length; a hub only costs a counted, pre-aggregated degree.

Everything stays in tables in the shared folder; nothing is collected. The labels of each restored layer are a table of their own, never
written again. Where a parent or a root holds many rows (a hub with a million leaves, one giant group), its rows are found by a broadcast of the hot keys,
of which there are few, and not by a task that holds them all.

Defined results: an edge with a null end joins nothing; loops, repeated and reversed edges count once; other
columns are ignored; no edges give no rows. Each vertex gets the least id of its group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.skew import lookup
from lexmill.session import Stages

#: Edges of the reduced core that one task may solve.
CORE_EDGES = 100_000
#: Tables of labels that are read side by side; more are put into one.
LAYERS = 24


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*")


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, root for a bounded number of edges: labels fall to the least id by repeated minima and jumps."""
    got = list(batches)
    a = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in got] or [np.zeros(0, np.int64)])
    b = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in got] or [np.zeros(0, np.int64)])
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        least = np.minimum(rx, ry)
        new = root.copy()
        np.minimum.at(new, rx, least)
        np.minimum.at(new, ry, least)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    if len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["v", "root"])


def _jump(arcs: DataFrame) -> DataFrame:
    """Each step's pointer goes on to where the step it points to points. nv null: the chain has ended, nw is its end; else (nv, nw) is a step that follows."""
    nxt = arcs.select(F.col("v").alias("nv"), F.col("w").alias("nw"), F.col("nv").alias("nv2"), F.col("nw").alias("nw2"), F.col("low").alias("low2"), F.lit(True).alias("there"))
    moved = F.col("nv2").isNotNull() & (F.col("low2") < F.col("low")) | F.col("there") & F.col("nv2").isNull()
    return arcs.join(nxt, ["nv", "nw"], "left").select(
        "v",
        "w",
        F.when(F.col("there"), F.col("nv2")).otherwise(F.col("nv")).alias("nv"),
        F.when(F.col("there"), F.col("nw2")).otherwise(F.col("nw")).alias("nw"),
        F.least("low", "low2").alias("low"),
        (F.col("moved") | F.coalesce(moved, F.lit(False))).alias("moved"),
    )


class _Reducer:
    def __init__(self, edges: DataFrame):
        self.stages = Stages(edges.sparkSession)
        self.edges = edges
        self.count = edges.count()
        self.hung: list[tuple[DataFrame, int]] = []

    def _replace(self, edges: DataFrame) -> None:
        new = self.stages.put(edges)
        self.stages.drop(self.edges)
        self.edges, self.count = new, new.count()

    def _hang(self, removed: DataFrame) -> int:
        table = self.stages.put(removed)
        if n := table.count():
            self.hung.append((table, n))
        else:
            self.stages.drop(table)
        return n

    def strip(self) -> bool:
        """One layer of leaves; of a lone pair the larger id is the leaf."""
        both = _both(self.edges)
        leaves = both.groupBy("v").agg(F.count("*").alias("n"), F.min("w").alias("parent")).where("n = 1").select("v", "parent")
        other = leaves.select(F.col("v").alias("parent"), F.col("parent").alias("v"), F.lit(True).alias("lone"))
        if not self._hang(leaves.join(other, ["v", "parent"], "left").where("lone is null or v > parent").select("v", "parent")):
            return False
        gone = self.hung[-1][0].select(F.least("v", "parent").alias("a"), F.greatest("v", "parent").alias("b"))
        self._replace(self.edges.join(gone, ["a", "b"], "left_anti"))
        return True

    def compress(self) -> bool:
        """Chains of degree-two vertices become one edge between their ends."""
        both = _both(self.edges)
        inner = self.stages.put(both.groupBy("v").agg(F.count("*").alias("n"), F.min("w").alias("x"), F.max("w").alias("y")).where("n = 2").select("v", "x", "y"))
        if inner.isEmpty():
            self.stages.drop(inner)
            return False
        # a state is a step that leaves an inner vertex: from v to w; it goes on if w is inner too
        steps = inner.select("v", F.explode(F.array("x", "y")).alias("w"))
        after = inner.select(F.col("v").alias("w"), "x", "y")
        arcs = steps.join(after, "w", "left").select(
            "v", "w", F.when(F.col("x").isNotNull(), F.col("w")).alias("nv"), F.when(F.col("x") == F.col("v"), F.col("y")).otherwise(F.col("x")).alias("nw"), F.least("v", "w").alias("low")
        )
        arcs = self.stages.put(arcs.select("v", "w", "nv", F.when(F.col("nv").isNotNull(), F.col("nw")).otherwise(F.col("w")).alias("nw"), "low"))
        going = True
        while going:
            jumped = self.stages.put(_jump(_jump(arcs.withColumn("moved", F.lit(False)))))  # two doublings to a table
            going = not jumped.where("moved").isEmpty()
            self.stages.drop(arcs)
            arcs = jumped
        ends = arcs.groupBy("v").agg(F.min("nw").alias("lo"), F.max("nw").alias("hi"), F.min("low").alias("low"), F.bool_or(F.col("nv").isNotNull()).alias("closed"))
        ends = self.stages.put(ends)
        removed = self._hang(ends.select("v", F.when(F.col("closed"), F.col("low")).otherwise(F.col("lo")).alias("parent")).where("v <> parent"))
        bridges = ends.where("not closed and lo <> hi").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        rest = _gone(self.edges, inner.select("v"))
        self._replace(rest.unionByName(bridges).distinct())
        self.stages.drop(inner, arcs, ends)
        return removed > 0

    def contract(self) -> None:
        """One round on a core without leaves or chains: each vertex points to its least neighbour if that is less,
        pointers are doubled up to vertices that point nowhere, and edges move up."""
        up = self.stages.put(_both(self.edges).groupBy("v").agg(F.min("w").alias("parent")).where("parent < v"))
        while True:
            far = up.select(F.col("v").alias("parent"), F.col("parent").alias("far"))
            jumped = self.stages.put(up.join(far, "parent", "left").select("v", F.coalesce("far", "parent").alias("parent"), F.col("far").isNotNull().alias("moved")))
            self.stages.drop(up)
            up = jumped.select("v", "parent")
            going = not jumped.where("moved").isEmpty()
            if not going:
                break
            self.stages.at[id(up)] = self.stages.at.pop(id(jumped))
        self.hung.append((up, up.count()))
        move = self.edges
        for side in ("a", "b"):
            move = lookup(move, up.select(F.col("v").alias(side), "parent"), side, self.count, "left").withColumn(side, F.coalesce("parent", side)).select("a", "b")
        self._replace(move.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _gone(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return edges.join(vertices.withColumnRenamed("v", "a"), "a", "left_anti").join(vertices.withColumnRenamed("v", "b"), "b", "left_anti")


def groups(edges: DataFrame, left: str = "left_rowid", right: str = "right_rowid", core_edges: int = CORE_EDGES) -> DataFrame:
    """rowid, group_rowid: every id that an edge joins to another one, and the least id of its group."""
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    clean = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    stages = Stages(edges.sparkSession)
    work = _Reducer(stages.put(clean))
    work.stages.at.update(stages.at)
    while work.count:
        before = work.count
        layer = before
        while work.strip() and work.count:
            if layer - work.count < 0.1 * layer:
                break
            layer = work.count
        if work.count:
            work.compress()
        if work.count <= core_edges:
            break
        if work.count > 0.9 * before:
            work.contract()
    parts = [work.stages.put(work.edges.coalesce(1).mapInArrow(union_find, "v bigint, root bigint"))] if work.count else []
    for removed, n in reversed(work.hung):
        # a parent that has no label yet was left without edges: it is the root of what hangs on it
        if parts:
            own = lookup(removed, _union(parts).select(F.col("v").alias("parent"), "root"), "parent", n, "left")
        else:
            own = removed.withColumn("root", F.lit(None).cast("bigint"))
        own = work.stages.put(own.select("v", "parent", F.coalesce("root", "parent").alias("root"), F.col("root").isNull().alias("top")))
        heads = own.where("top").select(F.col("parent").alias("v"), F.col("parent").alias("root")).distinct()
        parts += [own.select("v", "root"), heads]
        if len(parts) > LAYERS:
            parts = [work.stages.put(_union(parts))]
    if not parts:
        return work.edges.select(F.col("a").alias("rowid"), F.col("b").alias("group_rowid")).where("false")
    labels = work.stages.put(_union(parts)) if len(parts) > 1 else parts[0]
    least = labels.groupBy("root").agg(F.min("v").alias("group_rowid"))
    return lookup(labels, least, "root", labels.count()).select(F.col("v").alias("rowid"), "group_rowid")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def matched(edges: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Groups over the rows of near_edges at or above the threshold; a null similarity joins nothing."""
    return groups(edges.where(F.col("similarity") >= threshold))
