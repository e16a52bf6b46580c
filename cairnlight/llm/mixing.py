"""Mixtures of sources with target shares of the total size (problem 8)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.operators.ranking import running_total
from cairnlight.session import written


def tempered(shares: dict[str, float], targets: dict[str, float], exponent: float) -> dict[str, float]:
    """Normalised weights share^(1 - exponent) * target^exponent; with equal targets this is temperature mixing."""
    logs = {
        s: (1 - exponent) * math.log(shares[s]) + exponent * math.log(targets[s])
        for s in shares
        if shares[s] > 0 and targets.get(s, 0) > 0
    }
    if not logs:
        return {}
    top = max(logs.values())
    raw = {s: math.exp(v - top) for s, v in logs.items()}
    return {s: v / sum(raw.values()) for s, v in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect_exponent(
    shares: dict[str, float], targets: dict[str, float], max_repeats: dict[str, float] | None = None, target_entropy: float | None = None
) -> float:
    """The largest exponent in [0, 1] whose weights ask no source for more than max_repeats passes, or the one with the target entropy.

    Exponent 0 gives the natural shares (one pass of everything), 1 the targets.
    """
    if target_entropy is not None:
        low, high = 0.0, 1.0
        up = entropy(tempered(shares, targets, 1.0)) >= entropy(tempered(shares, targets, 0.0))
        for _ in range(80):
            mid = (low + high) / 2
            below = entropy(tempered(shares, targets, mid)) < target_entropy
            low, high = (mid, high) if below == up else (low, mid)
        return (low + high) / 2

    def fits(e: float) -> bool:
        w = tempered(shares, targets, e)
        # Without sources that have no documents, the remaining weights may ask a little more than a pass at 0.
        return all(v <= shares[s] * (max_repeats or {}).get(s, 1) * (1 + 1e-12) for s, v in w.items())

    if fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def filled_budgets(caps: dict[str, int], weights: dict[str, float], total: int) -> dict[str, int]:
    """Budgets in proportion to weights that add up to total (rounded down) and keep the caps: what a capped source can't take goes to the others.

    The common factor is found by bisection. If all caps together are below total, every source with a weight gets its cap.
    """
    open_ = {s: w for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0}
    if sum(caps[s] for s in open_) <= total:
        return {s: caps[s] if s in open_ else 0 for s in weights}
    low, high = 0.0, max(caps[s] / w for s, w in open_.items()) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(caps[s], mid * w) for s, w in open_.items()) < total else (low, mid)
    return {s: min(caps[s], int(high * w + 1e-6)) if (w := open_.get(s)) else 0 for s in weights}


class Mixture:
    """A mixture of the documents of df in which each source has its share of the total size.

    df: id, source and size columns; targets: source, weight_pct, max_repeats (set by hand, so small;
    repeated sources add up their weights and keep the largest cap, nulls count as 0). The total
    (default: the size of all documents, those without source included) is divided by normalised weights under the repetition limit: a source
    whose documents, repeated max_repeats times, don't fill its part gives all of that, and what it lacks is dealt to the others by weight (filled_budgets).
    weights: "targets" takes the given shares. "tempered" takes share^(1 - e) * target^e with the largest exponent e that asks no source for more
    than its cap (bisect_exponent); one exponent can't meet several given shares, so the report only shows these weights beside the targets (tempered_share).

    Sizes must not be negative; null sizes count as 0. Documents without a target are never used, nor are those of size 0.
    """

    def __init__(
        self, df: DataFrame, targets: DataFrame, id_column: str = "doc_id", source: str = "source", size: str = "size", budget: int | None = None, seed: int = 0, weights: str = "targets"
    ):
        self.spark, self.seed = df.sparkSession, seed
        self.items = written(df.select(F.col(id_column).alias("id"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size")))
        wanted = targets.filter("source is not null").groupBy("source").agg(
            F.coalesce(F.sum("weight_pct"), F.lit(0)).alias("w"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("m")
        )
        plan = {r["source"]: (int(r["w"]), int(r["m"])) for r in wanted.collect()}
        known = F.when(F.col("source").isin(list(plan)), F.col("source"))
        have = {r["s"]: int(r["n"] or 0) for r in self.items.groupBy(known.alias("s")).agg(F.sum("size").alias("n")).collect()}
        total = sum(have.values())
        self.total = total if budget is None else budget
        shares = {s: have.get(s, 0) / total if total else 0.0 for s in plan}
        limits = {s: m * (total / self.total if self.total else 0) for s, (_, m) in plan.items()}
        self.exponent = bisect_exponent(shares, {s: w / 100 for s, (w, _) in plan.items()}, limits)
        soft = tempered(shares, {s: w / 100 for s, (w, _) in plan.items()}, self.exponent)
        used = {s: soft.get(s, 0.0) for s in plan} if weights == "tempered" else {s: float(w) for s, (w, _) in plan.items()}
        parts = filled_budgets({s: have.get(s, 0) * m for s, (_, m) in plan.items()}, used, self.total)
        self.rows = []
        for s, (w, m) in sorted(plan.items()):
            size_s = have.get(s, 0)
            passes, rest = divmod(parts[s], size_s) if size_s else (0, 0)
            self.rows.append((s, w, m, size_s, w * self.total // 100, parts[s], int(passes), int(rest), soft.get(s, 0.0)))

    def _plan(self) -> DataFrame:
        return self.spark.createDataFrame(
            self.rows, "source string, weight_pct int, max_repeats int, size bigint, goal bigint, part bigint, passes int, rest bigint, tempered_share double"
        )

    def _last_pass(self, used: DataFrame) -> DataFrame:
        """Documents of the pass that isn't whole: in the order of a hash up to the budget, then past those that don't fit until none of the rest fits.

        Every round takes all documents whose running size stays within what is left of the source's budget, and goes on with the documents that were not
        taken and are not larger than what is left now, so the sum ends below the budget by less than the smallest document left out.
        """
        left = used.filter("rest > 0 and size <= rest").select("source", "id", "size", F.col("rest").alias("_room"))
        taken = left.select("source", "id", "size").limit(0)
        while True:
            sums = written(running_total(left, ["source"], "size", ["id"], "upto", self.seed))
            taken = taken.unionByName(sums.filter("upto <= _room").select("source", "id", "size"))
            spent = sums.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("upto") <= F.col("_room"), F.col("size"))), F.lit(0)).alias("_spent"))
            room = F.col("_room") - F.col("_spent")
            left = sums.filter("upto > _room").join(F.broadcast(spent), "source").filter(F.col("size") <= room).select("source", "id", "size", room.alias("_room"))
            if left.isEmpty():
                return taken

    def records(self) -> DataFrame:
        """(source, id, size, pass): one row for each use of a document. Whole passes repeat every document of the source, a last pass fills the budget."""
        plan = F.broadcast(self._plan().filter("part > 0").select("source", "passes", "rest"))
        used = self.items.filter("size > 0").join(plan, "source")
        whole = used.filter("passes > 0").select("source", "id", "size", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"))
        last = self._last_pass(used).join(plan.select("source", "passes"), "source").select("source", "id", "size", (F.col("passes") + 1).alias("pass"))
        return whole.unionByName(last)

    def sequence(self, block_size: int = 1 << 20) -> DataFrame:
        """(source, id, size, pass, block, place): the uses as a permutation in blocks; reading by (block, place) gives the mixture.

        The total is cut into blocks of about block_size. Each pass of a source is in a random order of its own; the uses are laid one after the
        other and cut into as many equal parts as there are blocks, so every block has each source in its share (up to one document). place is a random order inside the block.
        """
        uses = self.records()
        reached = {r["source"]: r["n"] for r in uses.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # one row for each target
        blocks = max(1, -(-sum(reached.values()) // block_size))
        if not reached:
            return uses.withColumns({"block": F.lit(0).cast("bigint"), "place": F.lit(0).cast("bigint")})
        sizes = self.spark.createDataFrame(sorted(reached.items()), "source string, _reached bigint")
        laid = running_total(uses, ["source", "pass"], "size", ["id", "pass"], "upto", self.seed).join(F.broadcast(sizes), "source")
        laid = laid.join(F.broadcast(self._plan().select("source", F.col("size").alias("_all"))), "source")
        begin = (F.col("pass") - 1) * F.col("_all") + F.col("upto") - F.col("size")
        block = F.floor(begin.cast("decimal(38,0)") * blocks / F.col("_reached")).cast("bigint")
        return laid.select("source", "id", "size", "pass", F.least(block, F.lit(blocks - 1)).alias("block"), F.xxhash64(F.lit(self.seed + 1), "pass", "id").alias("place"))

    def report(self) -> DataFrame:
        """Per target source: weight, size, goal, part (its budget), what was reached, repeats, whether its goal is in reach, its share of the total and of what came out.

        in_reach is read off the mixture: a source is out of reach if it has used all of its documents max_repeats times and is still below its weight.
        """
        got = self.records().groupBy("source").agg(F.sum("size").alias("reached"), F.max("pass").alias("repeats"))
        out = self._plan().join(got, "source", "left").withColumns({"reached": F.coalesce("reached", F.lit(0)), "repeats": F.coalesce("repeats", F.lit(0))})
        wide = lambda c: c.cast("decimal(38,0)")
        exhausted = wide(F.col("reached")) == wide(F.col("size")) * F.col("max_repeats")
        below = wide(F.col("reached")) * 100 < wide(F.lit(self.total)) * F.col("weight_pct")
        # One row per target source, so a window without a partition is no bottleneck.
        return out.withColumn("_all", F.sum("reached").over(Window.partitionBy())).select(
            "source", "weight_pct", "max_repeats", "size", "goal", "part", "reached", "repeats", (~(exhausted & below)).alias("in_reach"), F.round("tempered_share", 6).alias("tempered_share"),
            F.round(F.col("reached") / F.lit(max(1, self.total)), 6).alias("share_of_total"),
            F.round(F.col("reached") / F.nullif("_all", F.lit(0)), 6).alias("share_of_mixture"),
        )
