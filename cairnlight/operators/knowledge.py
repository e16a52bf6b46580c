"""Knowledge-graph operators on two tables: vertices and edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.operators.components import connected_components
from cairnlight.operators.ranking import global_rank, quantile
from cairnlight.session import written


def nodes_from_mentions(mentions: DataFrame, title: str, unit: str) -> DataFrame:
    """(title, text_unit_ids, frequency) of distinct mentions."""
    units = F.array_sort(F.collect_set(unit))
    return mentions.groupBy(title).agg(units.alias("text_unit_ids"), F.countDistinct(unit).alias("frequency"))


def cooccurrence(mentions: DataFrame, title: str, unit: str) -> DataFrame:
    """(source, target, weight): in how many units two titles occur together, source < target.

    Mentions are made distinct first, so a unit gives at most one pair for two titles however often they are repeated.
    """
    m = mentions.filter(F.col(title).isNotNull() & F.col(unit).isNotNull()).select(F.col(unit).alias("_u"), F.col(title).alias("_t")).distinct()
    a, b = m.withColumnRenamed("_t", "source"), m.withColumnRenamed("_t", "target")
    return a.join(b, "_u").filter("source < target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def canonical_edges(edges: DataFrame, order: str) -> DataFrame:
    """Undirected edges (source <= target); of repeated ones the weight of the last by order stays."""
    e = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight", order)
    return e.groupBy("source", "target").agg(F.max_by("weight", order).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(title, degree) of an undirected edge table; a self loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("title"))
    return ends.groupBy("title").agg(F.count(F.lit(1)).alias("degree"))


def with_combined_degree(edges: DataFrame, degree: DataFrame) -> DataFrame:
    s = degree.select(F.col("title").alias("source"), F.col("degree").alias("_s"))
    t = degree.select(F.col("title").alias("target"), F.col("degree").alias("_t"))
    joined = edges.join(s, "source", "left").join(t, "target", "left")
    return joined.withColumn("combined_degree", F.coalesce("_s", F.lit(0)) + F.coalesce("_t", F.lit(0))).drop("_s", "_t")


def pmi_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge weights p(xy) * log2(p(xy) / (p(x) p(y))) with the totals of all weights and all node frequencies."""
    total_w = edges.agg(F.sum("weight").alias("_w"))
    total_f = nodes.agg(F.sum("frequency").alias("_f"))
    n = nodes.join(F.broadcast(total_f)).select("title", (F.col("frequency") / F.col("_f")).alias("_p"))
    s, t = n.select(F.col("title").alias("source"), F.col("_p").alias("_px")), n.select(F.col("title").alias("target"), F.col("_p").alias("_py"))
    e = edges.join(F.broadcast(total_w)).withColumn("_pxy", F.col("weight") / F.col("_w")).join(s, "source").join(t, "target")
    return e.select("source", "target", (F.col("_pxy") * F.log2(F.col("_pxy") / (F.col("_px") * F.col("_py")))).alias("weight"))


def rank_fusion(edges: DataFrame, first: str, second: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two columns, largest first, ties share the smallest rank."""
    ranked = global_rank(global_rank(edges, first, "_r1"), second, "_r2")
    return ranked.withColumn("weight", 1 / (k + F.col("_r1")) + 1 / (k + F.col("_r2"))).drop("_r1", "_r2")


def pruned(nodes: DataFrame, edges: DataFrame, min_frequency: int = 2, min_degree: int = 1, percentile: float = 0.4, remove_ego: bool = True) -> DataFrame:
    """Edges left after pruning: the node of the highest degree (smallest title on ties), rare and thin nodes, then edges under the weight percentile.

    Degrees are those before the ego node goes; the percentile is taken over the edges that remain.
    """
    degree = degrees(edges)
    kept = nodes.join(degree, "title", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ego = degree.orderBy(F.desc("degree"), "title").limit(1).select("title") if remove_ego else None
    kept = kept.filter((F.col("frequency") >= min_frequency) & (F.col("degree") >= min_degree))
    if ego is not None:
        kept = kept.join(F.broadcast(ego), "title", "left_anti")
    left = edges.join(kept.select(F.col("title").alias("source")), "source", "left_semi").join(kept.select(F.col("title").alias("target")), "target", "left_semi")
    left = written(left.select("source", "target", "weight"))
    floor = quantile(left, "weight", percentile).withColumnRenamed("quantile", "_floor")
    return left.join(F.broadcast(floor)).filter("weight >= _floor").select("source", "target", "weight")


def largest_component(edges: DataFrame) -> DataFrame:
    """(node) of the largest connected component; of equally large ones that with the smallest node."""
    c = written(connected_components(edges, "source", "target"))
    best = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return c.join(F.broadcast(best), "component", "left_semi").select("node")


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(modularity) of an undirected weighted graph; membership: (node, community)."""
    s, t = membership.select(F.col("node").alias("source"), F.col("community").alias("_cs")), membership.select(F.col("node").alias("target"), F.col("community").alias("_ct"))
    e = edges.join(s, "source").join(t, "target")
    inside = e.filter("_cs = _ct").groupBy(F.col("_cs").alias("c")).agg(F.sum("weight").alias("w"))
    ends = e.select(F.explode(F.array(F.struct(F.col("_cs").alias("c"), "weight"), F.struct(F.col("_ct").alias("c"), "weight"))).alias("x")).groupBy("x.c").agg(F.sum("x.weight").alias("d"))
    m = e.agg(F.sum("weight").alias("m"))
    per = ends.join(inside, "c", "left").join(F.broadcast(m))
    return per.agg(F.sum(F.coalesce("w", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def modularity_by(edges: DataFrame, membership: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, modularity) of each part of a graph by itself; parts: (node, part), an edge belongs to the part of its source."""
    s, t = membership.select(F.col("node").alias("source"), F.col("community").alias("_cs")), membership.select(F.col("node").alias("target"), F.col("community").alias("_ct"))
    e = edges.join(s, "source").join(t, "target").join(parts.select(F.col("node").alias("source"), "part"), "source")
    total = e.groupBy("part").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("_cs") == F.col("_ct"), F.col("weight")).otherwise(0)).alias("w"))
    ends = e.select("part", F.explode(F.array("_cs", "_ct")).alias("c"), "weight").groupBy("part", "c").agg(F.sum("weight").alias("d"))
    null = ends.join(total.select("part", "m"), "part").groupBy("part").agg(F.sum(F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("q"))
    return total.join(null, "part").select("part", (F.col("w") / F.col("m") - F.col("q")).alias("modularity"))


def reachable(edges: DataFrame, starts: DataFrame, blocked: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """(node) reached from starts along source -> target, never passing through blocked nodes (these are not reached either).

    A frontier loop; each frontier is written to the shared folder and only new nodes go on.
    """
    e = edges.select("source", "target").distinct()
    if blocked is not None:
        e = e.join(blocked.select(F.col("node").alias("target")), "target", "left_anti")
        starts = starts.join(blocked, "node", "left_anti")
    front = written(starts.select("node").distinct())
    parts = [front]  # what was reached, rewritten as one table only now and then
    for _ in range(most):
        step = e.join(front.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, parts)
        front = written(step.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        parts = [*parts, front] if len(parts) < 16 else [written(seen.unionByName(front))]
    raise RuntimeError("the frontier did not settle")


def network_relationships(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with their place: 'in' when both ends are selected, 'out' when exactly one is; others are left out."""
    s = selected.select(F.col("title").alias("source"), F.lit(1).alias("_s")).distinct()
    t = selected.select(F.col("title").alias("target"), F.lit(1).alias("_t")).distinct()
    e = edges.join(s, "source", "left").join(t, "target", "left")
    both = F.coalesce("_s", F.lit(0)) + F.coalesce("_t", F.lit(0))
    return e.filter(both > 0).select("source", "target", "weight", F.when(both == 2, "in").otherwise("out").alias("network"))


def merge_entities(old: DataFrame, delta: DataFrame) -> DataFrame:
    """One row per title: id and type of the first (old before delta), all descriptions and unit ids, frequency = number of unit ids."""
    both = old.withColumn("_o", F.lit(0)).unionByName(delta.withColumn("_o", F.lit(1)))
    first = lambda c: F.min_by(c, F.struct("_o", "id"))
    lists = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", "id", F.col(c).alias("_v")))), lambda s: s["_v"]))
    out = both.groupBy("title").agg(
        first("id").alias("_id"), first("type").alias("type"), lists("description").alias("description"), lists("text_unit_ids").alias("text_unit_ids")
    )
    return out.withColumnRenamed("_id", "id").withColumn("frequency", F.size("text_unit_ids"))


def merge_relationships(old: DataFrame, delta: DataFrame) -> DataFrame:
    """One row per (source, target): first id, mean weight; combined degree from the number of merged edges at both ends."""
    both = old.withColumn("_o", F.lit(0)).unionByName(delta.withColumn("_o", F.lit(1)))
    e = both.groupBy("source", "target").agg(F.min_by("id", F.struct("_o", "id")).alias("id"), F.avg("weight").alias("weight"))
    count = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    return e.withColumn("combined_degree", count("source") + count("target"))


def document_delta(old: DataFrame, new: DataFrame, title: str) -> DataFrame:
    """(title, change): titles that are only in new ('new') or only in old ('deleted')."""
    a = new.select(title).distinct().join(old.select(title), title, "left_anti").withColumn("change", F.lit("new"))
    b = old.select(title).distinct().join(new.select(title), title, "left_anti").withColumn("change", F.lit("deleted"))
    return a.unionByName(b)


def shifted_communities(old: DataFrame, delta: DataFrame) -> DataFrame:
    """old and delta communities; the numbers of delta (and parents but -1) continue after old's largest."""
    top = old.agg(F.coalesce(F.max("community"), F.lit(-1)).alias("_m"))
    moved = delta.join(F.broadcast(top)).withColumns(
        {"community": F.col("community") + F.col("_m") + 1, "parent": F.when(F.col("parent") != -1, F.col("parent") + F.col("_m") + 1).otherwise(F.col("parent"))}
    )
    return old.unionByName(moved.drop("_m"))


def budget_prefix(df: DataFrame, group: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows in order as long as the running cost stays within budget; the first that exceeds it ends the group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Running sums of costs of at least 0 never fall, so keeping the sums within budget is the prefix.
    return df.withColumn("_run", F.sum(cost).over(w)).filter(F.col("_run") <= budget).drop("_run")


def budget_top(df: DataFrame, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows of the whole table in order as long as the running cost stays within budget, without sorting the table.

    No more rows fit than the budget holds of the smallest positive cost, beside those that cost nothing: so a top-k of that many comes first and the running
    sum is taken over it alone. Null costs count as 0; with costs of 0 the top-k grows by their number.
    """
    price = F.coalesce(F.col(cost), F.lit(0))
    least = df.agg(F.min(F.when(price > 0, price)).alias("least"), F.count_if(price <= 0).alias("free")).first()
    most = least["free"] + (int(budget // least["least"]) + 1 if least["least"] else 0)
    first = df.orderBy(*order).limit(most).withColumn("_g", F.lit(0)).withColumn("_cost", price)
    return budget_prefix(first, ["_g"], order, "_cost", budget).drop("_g", "_cost")


def greedy_batches(df: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """(group, order, cost, batch): a new batch from 0 starts where the next row would exceed the budget. A fold in order, streamed per task."""
    schema = f"{group} {df.schema[group].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, {cost} bigint, batch int"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, batch = object(), 0, 0
        for pdf in batches:
            numbers = []
            for g, c in zip(pdf[group], pdf[cost]):
                if g != at:
                    at, used, batch = g, 0, 0
                elif used + c > budget:
                    used, batch = 0, batch + 1
                used += c
                numbers.append(batch)
            yield pdf.assign(batch=numbers)

    rows = df.select(group, order, F.col(cost).cast("bigint").alias(cost))
    return rows.repartition(group).sortWithinPartitions(group, order).mapInPandas(fold, schema)


def modules_of(tree: dict) -> list[str]:
    """Leaf conditions of a nested And / Or / Not tree, in order."""
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        inner = node.get("conditions") or ([node["condition"]] if isinstance(node.get("condition"), dict) else [])
        if inner:
            stack += reversed(inner)
        else:
            out.append(node.get("condition_type", ""))
    return out
