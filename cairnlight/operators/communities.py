"""Hierarchical Leiden communities as steps over tables: no task and no driver holds a component."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.operators.components import connected_components
from cairnlight.session import written

#: Nodes move in turns, one of so many groups by hash at a time. Where a round in few turns doesn't raise the modularity, since neighbours moved at once, more turns are tried.
TURNS = (2, 4, 8)


def _quality(graph: DataFrame, nodes: DataFrame, member: DataFrame, resolution: float) -> float:
    """Modularity of a membership, every home with its own total: sums of one number per community."""
    c = member.select(F.col("node").alias("a"), F.col("c").alias("ca"))
    inside = graph.join(c, "a").join(c.toDF("b", "cb"), "b").filter("ca = cb").join(nodes.select(F.col("node").alias("a"), "m2"), "a").select((F.col("w") / F.col("m2")).alias("q"))
    degree = nodes.join(member, "node").groupBy("c").agg((F.sum("k") / F.max("m2")).alias("x")).select((-resolution * F.col("x") * F.col("x")).alias("q"))
    return inside.unionByName(degree).agg(F.sum("q")).first()[0] or 0.0


def _moved(graph: DataFrame, nodes: DataFrame, member: DataFrame, resolution: float) -> DataFrame:
    """(node, c) after local moves: nodes go to the neighbouring community with the largest gain until the modularity doesn't rise any more."""
    best, best_quality, step = member, None, 0
    while True:
        turns = []
        for turn in range(TURNS[step]):
            state = nodes.join(member, "node")
            total = state.groupBy("c").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
            mine = F.pmod(F.xxhash64("a"), F.lit(TURNS[step])) == turn
            own = state.join(total, "c").select(
                F.col("node").alias("a"), F.col("c").alias("own"), "k", "m2", (F.col("total") - F.col("k")).alias("others"), F.col("size").alias("own_size")
            ).filter(mine)
            near = graph.join(member.select(F.col("node").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w")).join(own, "a").join(total, "c")
            # Of two single nodes only the one with the larger name joins the other, so they don't change places.
            near = near.filter("not (own_size = 1 and size = 1 and c > own)")
            gain = F.col("w") - resolution * F.col("k") * F.when(F.col("c") == F.col("own"), F.col("others")).otherwise(F.col("total")) / F.col("m2")
            top = near.withColumn("gain", gain).groupBy("a").agg(
                F.min(F.struct(-F.round("gain", 9), "c")).alias("to"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"),
                F.max(-resolution * F.col("k") * F.col("others") / F.col("m2")).alias("alone"),
            )
            go = top.filter(-F.col("to")["col1"] > F.coalesce("stay", "alone") + 1e-6).select(F.col("a").alias("node"), F.col("to")["c"].alias("_to"))
            after = written(member.join(go, "node", "left").select("node", F.coalesce("_to", "c").alias("c"), F.col("_to").isNotNull().alias("moved")))
            turns.append(after.filter("moved"))
            member = after.select("node", "c")
        if reduce(DataFrame.unionByName, turns).isEmpty():
            return member
        if best_quality is None:
            best_quality = _quality(graph, nodes, best, resolution)
        quality = _quality(graph, nodes, member, resolution)
        if quality > best_quality + 1e-9:
            best, best_quality = member, quality
        elif step + 1 < len(TURNS):
            step, member = step + 1, best
        else:
            return best


def leiden(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(home, node, community) of weighted undirected edges (home, source, target, weight); every home is a graph of its own.

    The three phases of Leiden, each as joins and aggregations: local moves of nodes, refinement of every community from single nodes inside it, and aggregation of
    the refined communities into a smaller graph, which starts from the communities found before. It ends when a graph isn't made smaller. Communities are connected and
    named by their smallest node. Repeated edges add up; self loops count for the degree; null ends are ignored.
    """
    e = edges.filter("source is not null and target is not null").select(
        "home", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.col("weight").cast("double").alias("w")
    )
    e = written(e.groupBy("home", "a", "b").agg(F.sum("w").alias("w")))
    links = e.filter("a <> b").select("a", "b", "w")
    graph = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    ends = e.select("home", F.col("a").alias("node"), "w").unionByName(e.select("home", F.col("b").alias("node"), "w"))
    degree = ends.groupBy("home", "node").agg(F.sum("w").alias("k"))
    nodes = written(degree.join(degree.groupBy("home").agg(F.sum("k").alias("m2")), "home"))
    homes = nodes.select("home", "node")
    place = nodes.select("node", F.col("node").alias("r"))  # the node of the present graph in which an original node is
    member = nodes.select("node", F.col("node").alias("c"))
    while True:
        member = _moved(graph, nodes, member, resolution)
        ca, cb = member.toDF("a", "ca"), member.toDF("b", "cb")
        inner = written(graph.join(ca, "a").join(cb, "b").filter("ca = cb").select("a", "b", "w"))
        refined = _moved(inner, nodes, nodes.select("node", F.col("node").alias("c")), resolution).withColumnRenamed("c", "r")
        place, before = written(place.join(refined.select(F.col("node").alias("r"), F.col("r").alias("_r")), "r").select("node", F.col("_r").alias("r"))), nodes.count()
        sizes = nodes.join(refined, "node").groupBy("r").agg(F.sum("k").alias("k"), F.first("m2").alias("m2"), F.first("home").alias("home"))
        start = member.join(refined, "node").groupBy(F.col("r").alias("node")).agg(F.min("c").alias("c"))
        smaller = written(sizes.select("home", F.col("r").alias("node"), "k", "m2"))
        member = written(start)
        if smaller.count() == before:
            break
        ra, rb = refined.toDF("a", "ra"), refined.toDF("b", "rb")
        graph = written(graph.join(ra, "a").join(rb, "b").filter("ra <> rb").groupBy(F.col("ra").alias("a"), F.col("rb").alias("b")).agg(F.sum("w").alias("w")))
        nodes = smaller
    found = written(place.join(member.select(F.col("node").alias("r"), "c"), "r").select("node", "c"))
    # What a community holds apart from each other becomes communities of its own; nodes without a link inside are alone.
    ca, cb = found.toDF("a", "ca"), found.toDF("b", "cb")
    joined = links.join(ca, "a").join(cb, "b").filter("ca = cb")
    parts = connected_components(joined, "a", "b").select("node", F.col("component").alias("community"))
    return homes.join(parts, "node", "left").select("home", "node", F.coalesce("community", "node").alias("community"))


def hierarchical_leiden(edges: DataFrame, max_size: int = 10, resolution: float = 1.0) -> DataFrame:
    """(node, level, community, parent): communities at level 0; those with more than max_size nodes are divided again at the next level, as far as they can be divided.

    edges: source, target, weight. Communities are named by level and smallest node; parent is null at level 0. A community that can't be divided stays as it is, whatever its size.
    """
    e = edges.select("source", "target", F.col("weight").cast("double").alias("weight"))
    inside = e.withColumn("home", F.lit(""))
    out, level = None, 0
    while True:
        found = leiden(inside, resolution)
        sizes = found.groupBy("home", "community").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy("home"))) if level else sizes.withColumn("parts", F.lit(2))
        # A home that stays in one part isn't a division.
        kept = written(found.join(sizes, ["home", "community"]).filter("parts > 1"))
        if kept.isEmpty():
            break
        name = F.concat(F.lit(f"{level}:"), "community")
        rows = kept.select("node", F.lit(level).alias("level"), name.alias("community"), F.when(F.lit(level > 0), F.col("home")).alias("parent"))
        out = rows if out is None else out.unionByName(rows)
        large = written(kept.filter(F.col("n") > max_size).select("node", name.alias("home")))
        if large.isEmpty():
            break
        s, t = large.toDF("source", "hs"), large.toDF("target", "ht")
        inside = e.join(s, "source").join(t, "target").filter("hs = ht").select("source", "target", "weight", F.col("hs").alias("home"))
        level += 1
    return out if out is not None else e.sparkSession.createDataFrame([], "node string, level int, community string, parent string")


def community_table(membership: DataFrame, edges: DataFrame, period: str) -> DataFrame:
    """One row per community: community, level, parent, children, size, relationships and their weight inside, period and title.

    Which nodes and relationships belong to a community stays a table of links (membership), so no row holds them all; children are few by nature.
    """
    size = membership.groupBy("community", "level").agg(F.count(F.lit(1)).alias("size"), F.max("parent").alias("parent"))
    a = membership.select(F.col("node").alias("source"), "community")
    b = membership.select(F.col("node").alias("target"), F.col("community").alias("_c"))
    inner = edges.join(a, "source").join(b, "target").filter("community = _c").groupBy("community").agg(F.count(F.lit(1)).alias("relationships"), F.sum("weight").alias("weight"))
    kids = size.filter("parent is not null").groupBy(F.col("parent").alias("community")).agg(F.array_sort(F.collect_list("community")).alias("children"))
    out = size.join(inner, "community", "left").join(kids, "community", "left")
    return out.select(
        "community", "level", "parent", F.coalesce("children", F.array().cast("array<string>")).alias("children"), "size", F.coalesce("relationships", F.lit(0)).alias("relationships"),
        F.coalesce("weight", F.lit(0)).alias("weight"), F.lit(period).alias("period"), F.concat(F.lit("Community "), "community").alias("title"),
    )
