"""Search contexts under token budgets, hierarchies and state graphs, built from the smaller operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.operators.knowledge import budget_prefix, budget_top, greedy_batches, network_relationships, reachable
from cairnlight.session import written


def context_table(df: DataFrame, name: str, columns: list[str], order: list[Column], delimiter: str = "|") -> DataFrame:
    """(context): one text with a title, a header and a line per row, in order. For results already cut to a budget."""
    line = F.concat_ws(delimiter, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    numbered = df.select(F.row_number().over(Window.orderBy(*order)).alias("_i"), line.alias("_l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_l"))), lambda s: s["_l"]), "\n")
    head = f"-----{name}-----\n{delimiter.join(columns)}\n"
    return numbered.agg(F.concat(F.lit(head), body).alias("context"))


def local_context(
    entities: DataFrame, relationships: DataFrame, units: DataFrame, reports: DataFrame, selected: DataFrame, budget: int, report_share: float = 0.25, unit_share: float = 0.5
) -> DataFrame:
    """(part, id, cost): what a local search puts before the model.

    selected: (title, place) of the matched entities. A share of the budget goes to the reports of communities with most
    matches, one to text units in the order of their first entity and then by shared relationships, the rest to the
    entities and their relationships (both ends matched first, then by links and weight). Each part stops at its first overflow.

    entities: title, cost; relationships: source, target, weight, cost; units: unit, title, cost; reports: community, title, cost.
    """
    if report_share + unit_share > 1:
        raise ValueError("the shares exceed the budget")
    rest = int(budget * (1 - report_share - unit_share))
    matched = reports.join(selected, "title", "left_semi").groupBy("community").agg(F.countDistinct("title").alias("n"), F.max("cost").alias("cost"))
    part = lambda df, name, key, order, size: budget_top(df, order, "cost", size).select(F.lit(name).alias("part"), F.col(key).cast("string").alias("id"), "cost")
    a = part(matched, "report", "community", [F.desc("n"), F.col("community")], int(budget * report_share))
    e = part(entities.join(selected, "title"), "entity", "title", [F.col("place"), F.col("title")], rest)
    net = network_relationships(relationships, selected)
    ranked = net.join(relationships.select("source", "target", "cost"), ["source", "target"]).withColumn("key", F.concat_ws("~", "source", "target"))
    r = part(ranked, "relationship", "key", [F.col("network"), F.desc("weight"), F.col("key")], rest)
    hits = units.join(selected, "title")
    links = units.join(net.select(F.explode(F.array("source", "target")).alias("title")).distinct(), "title", "left_semi").groupBy("unit").agg(F.countDistinct("title").alias("links"))
    first = hits.groupBy("unit").agg(F.min("place").alias("place"), F.max("cost").alias("cost")).join(links, "unit", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    u = part(first, "unit", "unit", [F.col("place"), F.desc("links"), F.col("unit")], int(budget * unit_share))
    return a.unionByName(e).unionByName(r).unionByName(u)


def global_points(reports: DataFrame, order: str, cost: str, budget: int, rate: Callable[[DataFrame], DataFrame], reduce_budget: int) -> DataFrame:
    """Map and reduce of a global search: batches of reports by budget, rate(batches) gives (batch, point, score, cost), zeros leave, best first under the reduce budget."""
    rows = reports.withColumn("_g", F.lit(0))
    batches = greedy_batches(rows, "_g", order, cost, budget).drop("_g")
    points = written(rate(batches).filter("score > 0"))
    return budget_top(points, [F.desc("score"), F.col("batch"), F.col("point")], "cost", reduce_budget)


def drift_frontier(actions: DataFrame, k: int) -> DataFrame:
    """The k open actions with the highest score; without a score they come last (ties by id)."""
    return actions.filter("not answered").orderBy(F.desc_nulls_last("score"), "action").limit(k)


def drift_search(start: DataFrame, follow: Callable[[DataFrame, int], DataFrame], depth: int, k: int) -> DataFrame:
    """Actions (action, score, answered, depth) after `depth` rounds: the best k open ones are answered and give follow-ups."""
    state = written(start.select("action", "score", F.lit(False).alias("answered"), F.lit(0).alias("depth")))
    for n in range(1, depth + 1):
        chosen = written(drift_frontier(state, k).select("action"))
        more = follow(chosen, n).select("action", "score", F.lit(False).alias("answered"), F.lit(n).alias("depth")).join(state.select("action"), "action", "left_anti")
        done = state.join(chosen.withColumn("_c", F.lit(True)), "action", "left").withColumn("answered", F.col("answered") | F.coalesce("_c", F.lit(False))).drop("_c")
        state = written(done.unionByName(more))
    return state


def selected_communities(tree: DataFrame, rating: str, threshold: float) -> DataFrame:
    """Communities (community) chosen from the top: relevant ones are replaced by their relevant children; if a whole level has none, the next is tried.

    tree: community, parent, level and a rating column; a level-wise loop over small frontiers.
    """
    levels = [r["level"] for r in tree.select("level").distinct().orderBy("level").collect()]
    chosen = tree.limit(0).select("community")
    front = written(tree.filter(F.col("level") == levels[0]).select("community")) if levels else chosen
    for i, level in enumerate(levels):
        here = tree.filter((F.col("level") == level) & (F.col(rating) >= threshold)).join(front, "community", "left_semi").select("community", "parent")
        here = written(here)
        parents = here.select(F.col("parent").alias("community")).distinct()
        chosen = written(chosen.join(parents, "community", "left_anti").unionByName(here.select("community")))
        if i + 1 == len(levels):
            break
        below = tree.filter(F.col("level") == levels[i + 1])
        if here.isEmpty() and chosen.isEmpty():
            front = written(below.select("community"))
        else:
            front = written(below.join(here.select(F.col("community").alias("parent")), "parent", "left_semi").select("community"))
    return chosen


def level_contexts(rows: DataFrame, reports: DataFrame, parents: DataFrame, budget: int) -> DataFrame:
    """(community, kind, cost): contexts within budget as they are, larger ones by the reports of their sub-communities (largest first), the rest trimmed.

    rows: community, item, rank, cost; reports: community, cost of finished reports; parents: community (child), parent.
    """
    total = rows.groupBy("community").agg(F.sum("cost").alias("cost"))
    fits = total.filter(F.col("cost") <= budget).select("community", F.lit("valid").alias("kind"), "cost")
    large = total.filter(F.col("cost") > budget)
    kids = reports.join(parents, "community").select(F.col("parent").alias("community"), F.col("community").alias("child"), "cost")
    kept = budget_prefix(kids.join(large.select("community"), "community", "left_semi"), ["community"], [F.desc("cost"), F.col("child")], "cost", budget)
    swapped = kept.groupBy("community").agg(F.sum("cost").alias("cost")).select("community", F.lit("substituted").alias("kind"), "cost")
    left = large.join(swapped, "community", "left_anti").select("community")
    cut = budget_prefix(rows.join(left, "community", "left_semi"), ["community"], [F.desc("rank"), F.col("item")], "cost", budget)
    trimmed = cut.groupBy("community").agg(F.sum("cost").alias("cost")).select("community", F.lit("trimmed").alias("kind"), "cost")
    return fits.unionByName(swapped).unionByName(trimmed)


def shifted_indexes(parts: list[tuple[str, DataFrame]], number: str, text_id: str) -> DataFrame:
    """Several indexes as one: numbers continue after the largest of the earlier ones (-1 stays), text ids get the index's name; `index` says where a row comes from."""
    out, offset = None, 0
    for name, df in parts:
        top = df.agg(F.max(number)).first()[0]
        moved = df.withColumn(number, F.when(F.col(number) != -1, F.col(number) + offset).otherwise(F.col(number))).withColumn(text_id, F.concat(F.col(text_id), F.lit(f"-{name}"))).withColumn("index", F.lit(name))
        out = moved if out is None else out.unionByName(moved)
        offset += (top if top is not None else -1) + 1
    return out


def gate_classes(edges: DataFrame, gates: DataFrame, targets: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, class): nodes that lie on a way from starts to targets, with the strongest gate: visible > hidden > demographic > skip; none stays null.

    gates: node, gate. The two reachability loops run over frontiers; what both reach is on a way.
    """
    ahead = reachable(edges, starts)
    back = reachable(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), targets)
    strength = F.create_map(*[x for i, g in enumerate(("skip", "demographic", "hidden", "visible")) for x in (F.lit(g), F.lit(i))])
    best = gates.groupBy("node").agg(F.max_by("gate", strength[F.col("gate")]).alias("class"))
    return ahead.join(back, "node", "left_semi").join(best, "node", "left")
