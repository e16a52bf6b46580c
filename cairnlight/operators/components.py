"""Connected components by hooking and shortcutting over parent arrays held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.session import written


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected edge table; component is the smallest node of the component.

    Every node starts with the smallest of itself and its neighbours as parent. Each round
    hooks the parent of both ends of every edge onto the smaller parent beside it (min per node,
    combined before the shuffle, so a hub costs no more than its edges) and then shortcuts twice
    (parent := parent of parent). Edges whose ends share a parent are dropped for good, and each
    round's tables are written to the shared folder. Rounds are logarithmic in the diameter.
    Null ends and self loops: nodes of self loops are components of their own, rows with a null
    end are ignored. An empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = pairs.union(pairs.select("v", "u"))
    parent = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("parent")))
    live = pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    for _ in range(max_rounds):
        p = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        q = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        live = written(live.join(p, "u").join(q, "v").filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        if live.isEmpty():
            return _flat(parent)
        hooks = live.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("hook"))
        hooked = parent.join(hooks, "node", "left").select("node", F.least("parent", "hook").alias("parent"))
        parent = written(_shortcut(written(_shortcut(hooked))))
    raise RuntimeError("components did not settle")


def _shortcut(parent: DataFrame) -> DataFrame:
    above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
    return parent.join(above, "parent", "left").select("node", F.least("parent", "up").alias("parent"))


def _flat(parent: DataFrame) -> DataFrame:
    """Follows parents until all are roots."""
    while True:
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        step = written(parent.join(above, "parent", "left").select("node", "parent", F.least("parent", "up").alias("up")))
        if step.filter("up < parent").isEmpty():
            return step.select("node", F.col("parent").alias("component"))
        parent = step.select("node", F.col("up").alias("parent"))
