"""Splits that keep related records together (problem 2).

Records are joined by the keys they share (cluster, text, author, source, entity). Components are found by frontier
breadth-first search: adjacency lists are hash-partitioned by vertex, a quarter of the vertices (by a hash)
are seeds that expand at once; where two labels meet, the pair goes into a small graph of labels, which one
task solves if it has at most ``MERGE_EDGES`` edges, and the same search otherwise (from seeds of which no two
are neighbours, so that it at least halves); vertices that no seed reached begin again, from those
with the least hash among their neighbours. Labels are tables of one hop each, never written again. The vertices are the keys,
as 128 bits of a digest, and records with several keys make the edges, but for a key that only one other key and no record by itself
needs: it joins nothing. A key with a third of all records is one vertex; the list of a vertex with over ``HUB`` neighbours is cut into parts.

Components then go to the splits in the order of a hash: components that hold over ``LARGE`` of the records (at most 1 / LARGE
of them) are placed first, each where most room is left; of the rest, those whose records end before 90 % in hash order go to train,
and so on. The running sum over components is cut into hash ranges whose totals are summed first, so no task holds all.

Defined results: rows without id are left out; a record whose keys are all null is a component of its own; no
records give no rows. A record in two clusters joins them to one component, and counts in both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.components import union_find
from lexmill.operators.records import latest, split_name
from lexmill.operators.skew import lookup
from lexmill.session import Stages, broadcast_if, hex64

PROPORTIONS = (("train", 0.90), ("validation", 0.05), ("test", 0.05))
SEED_SHARE = 4
MERGE_EDGES = 100_000
LARGE = 0.01
RANGES = 4096
#: Neighbours of a vertex whose list is one task's work at most; vertices that may be broadcast.
HUB, HUBS = 100_000, 50_000
#: Tables of labels that are read side by side; more are put into one.
HOPS = 12


def _order(c):
    return F.conv(F.substring(F.sha2(F.concat(F.lit("split\0"), c), 256), 1, 15), 16, 10).cast("bigint")


def _lists(edges: DataFrame, stages: Stages, hub: int) -> DataFrame:
    """Adjacency lists: v, part, w, parts (of w). The neighbours of a hub are dealt into parts by a hash."""
    both = edges.where("a is not null and b is not null and a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*").distinct()
    both = stages.put(both)
    hubs = both.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("v", F.ceil(F.col("n") / hub).cast("int").alias("parts"))
    hubs = stages.put(hubs)
    if (n := hubs.count()) == 0:
        return both.select("v", F.lit(0).alias("part"), "w", F.lit(1).alias("parts"))
    hubs = broadcast_if(hubs, n, HUBS)
    cut = both.join(hubs, "v", "left").select("v", F.pmod(F.xxhash64("w"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "w")
    out = stages.put(cut.join(hubs.withColumnRenamed("v", "w"), "w", "left").select("v", "part", "w", F.coalesce("parts", F.lit(1)).alias("parts")))
    stages.drop(both)
    return out


def search(edges: DataFrame, seed_share: int | None = SEED_SHARE, merge_edges: int = MERGE_EDGES, hub: int = HUB) -> DataFrame:
    """v, root for edges (a, b): root is the same in a component. Written tables hold each step."""
    stages = Stages(edges.sparkSession)
    kind = edges.schema["a"].dataType.simpleString()
    adjacency = _lists(edges, stages, hub)
    labels: list[DataFrame] = []
    meetings: list[DataFrame] = []
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    while True:
        open_ = adjacency.join(union(labels).select("v"), "v", "left_anti") if labels else adjacency
        hashed = open_.groupBy("v").agg(F.min(F.xxhash64("w")).alias("least"), (F.max("part") + 1).alias("parts")).withColumn("h", F.xxhash64("v"))
        early = F.pmod("h", F.lit(seed_share)) == 0 if seed_share else F.lit(False)
        frontier = stages.put(hashed.where(early | (F.col("h") <= F.col("least"))).select("v", F.col("v").alias("label"), "parts"))
        if frontier.isEmpty():
            break
        while not frontier.isEmpty():
            labels.append(frontier)
            if len(labels) > HOPS:  # the last one is the frontier, which goes on being read by itself
                one = stages.put(union(labels[:-1]))
                stages.drop(*labels[:-1])
                labels = [one, labels[-1]]
            grown = union(labels).select("v", F.col("label").alias("own"))
            dealt = frontier.select("v", "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            reached = dealt.join(adjacency, ["v", "part"]).select(F.col("w").alias("v"), "label", "parts").distinct().join(grown, "v", "left")
            reached = stages.put(reached)
            best = reached.where("own is null").groupBy("v").agg(F.min("label").alias("label"), F.max("parts").alias("parts"))
            ahead = stages.put(best)
            known = reached.where("own <> label").select(F.col("own").alias("a"), F.col("label").alias("b"))
            ties = reached.where("own is null").drop("own").join(ahead.select("v", F.col("label").alias("own")), "v").where("own <> label").select(F.col("own").alias("a"), F.col("label").alias("b"))
            meetings.append(stages.put(known.unionByName(ties).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
            stages.drop(reached)
            frontier = ahead
    if not labels:
        return adjacency.select("v", F.col("w").alias("root")).where("false")
    every = union(labels).select("v", F.col("label").alias("root"))
    met = stages.put(union(meetings).distinct())
    stages.drop(*meetings)
    n = met.count()
    if not n:
        return every
    merged = met.coalesce(1).mapInArrow(union_find, f"root {kind}, merged {kind}") if n <= merge_edges else search(met, None, merge_edges, hub).toDF("root", "merged")
    merged = stages.put(merged)
    return lookup(every, merged, "root", every.count(), "left").select("v", F.coalesce("merged", "root").alias("root"))


def _name(key: str) -> Column:
    """The vertex of a key's value: 128 bits of a digest, so that values of several keys never meet and take little room."""
    return F.unhex(F.md5(F.concat(F.lit(f"{key}\0"), F.col(key).cast("string"))))


def components(records: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """id, component: the least vertex among the keys joined to the record's keys, or the record's own vertex, in hex."""
    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(i).alias("i"), _name(k).alias("key"))) for i, k in enumerate(keys)])).alias("names"))
    # a record may have several rows: its first key, by the keys' order, stands for it
    named = rows.select("id", F.explode_outer("names").alias("x")).select("id", "x.*")
    stages = Stages(records.sparkSession)
    own = named.groupBy("id").agg(F.min(F.struct("i", "key")).alias("first"), F.max(F.struct("i", "key")).alias("last"))
    own = stages.put(own.select("id", F.col("first.key").alias("key"), (F.col("first") != F.col("last")).alias("several")))
    pairs = named.join(own.where("several").select("id", F.col("key").alias("a")), "id").where("a <> key").select("a", F.col("key").alias("b")).distinct()
    # a key that one other key has met, and that stands for no record, joins nothing
    alone = own.where("not several and key is not null").select(F.col("key").alias("b")).distinct()
    meets = pairs.groupBy("b").agg(F.count("*").alias("n"), F.first("a").alias("_")).drop("_").unionByName(alone.select("b", F.lit(0).cast("bigint").alias("n")))
    meets = stages.put(meets.groupBy("b").agg(F.count("*").alias("kinds"), F.max("n").alias("n")).where("n > 1 or (n = 1 and kinds > 1)").select("b"))
    edges = stages.put(pairs.join(broadcast_if(meets, meets.count(), HUBS), "b", "left_semi").select("a", "b"))
    roots = stages.put(search(edges))
    least = stages.put(roots.groupBy("root").agg(F.min("v").alias("least")))
    met = roots.count()
    back = lookup(roots, least, "root", met).select(F.col("v").alias("key"), F.col("least"))
    alias = F.concat(F.lit("record-"), F.md5(F.col("id").cast("string")))
    out = own.join(F.broadcast(back), "key", "left") if met <= HUBS else lookup(own, back, "key", own.count(), "left")
    return out.select("id", F.coalesce(F.lower(F.hex(F.coalesce("least", "key"))), alias).alias("component"))


def assign(members: DataFrame, proportions=PROPORTIONS) -> DataFrame:
    """component, records, split for members (id, component), by component hash order."""
    stages = Stages(members.sparkSession)
    sizes = stages.put(members.groupBy("component").agg(F.count("*").alias("records")).withColumn("h", _order(F.col("component"))))
    total = sizes.agg(F.sum("records")).first()[0] or 0
    room = {name: share * total for name, share in proportions}
    placed = []
    for row in sizes.where(F.col("records") > LARGE * total).orderBy(F.desc("records"), "h", "component").collect():  # at most 1 / LARGE rows
        name = max(room, key=room.get)
        room[name] -= row.records
        placed.append((row.component, name))
    large = members.sparkSession.createDataFrame(placed, "component string, large string")
    rest = sizes.join(F.broadcast(large), "component", "left_anti").withColumn("range", F.floor(F.col("h") / F.lit((1 << 60) // RANGES)))
    sums = rest.groupBy("range").agg(F.sum("records").alias("n")).withColumn("before_range", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("range").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, 0)
    ends = rest.join(F.broadcast(sums.select("range", "before_range")), "range").withColumn("end", F.col("before_range") + F.sum("records").over(inside))
    split = F.lit(proportions[-1][0])
    for name, _ in reversed(proportions[:-1]):
        left_after = sum(max(0.0, room[n]) for n, _ in proportions[: [p for p, _ in proportions].index(name) + 1])
        split = F.when(F.col("end") - F.col("records") / 2 <= left_after, name).otherwise(split)
    small = ends.select("component", "records", split.alias("split"))
    return small.unionByName(sizes.join(F.broadcast(large), "component").select("component", "records", F.col("large").alias("split")))


def related(counts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Each counted record: document_id, cluster_id, text_hash, component, present (its present split). Written once.

    The latest row of a document holds with all its values, so a null count is the count of a record that has one."""
    now = latest(counts).select("document_id", split_name(F.col("split")).alias("present"))
    keys = manifests.select("document_id", hex64(F.col("duplicate_cluster_id")).alias("cluster_id"), hex64(F.col("canonical_text_hash")).alias("text_hash"))
    keys = keys.where("document_id is not null and (cluster_id is not null or text_hash is not null)").distinct()
    stages = Stages(counts.sparkSession)
    pairs = stages.put(now.join(keys, "document_id", "left"))
    found = components(pairs, "document_id", ["cluster_id", "text_hash"])
    return pairs.join(found.withColumnRenamed("id", "document_id"), "document_id")


def torn(records: DataFrame) -> DataFrame:
    """cluster_id of the clusters whose counted records have more than one present split.

    A cluster lies within one component of the search, so each component names its own torn clusters; the partial aggregates keep the shuffle
    to a row for each cluster and task."""
    full = records.where("cluster_id is not null and present is not null")
    return full.groupBy("component", "cluster_id").agg(F.min("present").alias("a"), F.max("present").alias("b")).where("a <> b").select("cluster_id")


def torn_components(records: DataFrame) -> DataFrame:
    """component, records, clusters, splits: the components, joined by clusters and texts, that the present split tears apart."""
    per = records.where("present is not null").groupBy("component", "document_id").agg(F.min("present").alias("a"), F.max("cluster_id").alias("c"))
    each = per.groupBy("component").agg(F.count("*").alias("records"), F.min("a").alias("x"), F.max("a").alias("y"), F.collect_set("a").alias("s"))
    clusters = records.where("present is not null and cluster_id is not null").groupBy("component", "cluster_id").agg(F.lit(1).alias("one")).groupBy("component").agg(F.sum("one").alias("clusters"))
    torn_ones = each.where("x <> y").select("component", "records", F.array_join(F.array_sort("s"), ",").alias("splits"))
    return torn_ones.join(clusters, "component", "left").select("component", "records", F.coalesce("clusters", F.lit(0)).alias("clusters"), "splits")
