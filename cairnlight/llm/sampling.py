"""Samples whose category shares match given targets (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.operators.ranking import hash_rank


def normal_condition(column: str | Column) -> Column:
    """Lower case, without white space (of any Unicode kind) around it; null stays null, blank becomes empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def divisor_seats(available: dict[str, int], shares: dict[str, float], floors: dict[str, int], size: int) -> dict[str, int]:
    """Seats of each category when size records are taken by ascending priority.

    A category's k-th record has priority (k - 0.5) / share; the first floors[c] records come before
    all others. So with a threshold t a category has round(t * share) records, at least its floor and
    at most what it has; t is found by bisection, then the last seats go one by one to the smallest
    priorities (ties by name). Exhausted categories stop and the rest shifts to the others. A category
    with share 0 gets its floor only. If the floors alone exceed size, they are kept whole.
    """
    names = sorted(shares)
    seats = {c: min(floors.get(c, 0), available.get(c, 0)) for c in names}
    open_ = [c for c in names if shares[c] > 0 and available.get(c, 0) > seats[c]]
    rest = min(size, sum(available.get(c, 0) for c in names)) - sum(seats.values())
    if rest <= 0 or not open_:
        return seats

    def at(t: float) -> dict[str, int]:
        return seats | {c: max(seats[c], min(available[c], int(t * shares[c] + 0.5))) for c in open_}

    goal, low, high = rest + sum(seats.values()), 0.0, 1.0
    top = sum(at(float("1e18")).values())
    while sum(at(high).values()) < min(goal, top):
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(at(mid).values()) < goal else (low, mid)
    got = at(low)
    while sum(got.values()) < goal:
        left = [c for c in open_ if got[c] < available[c]]
        if not left:
            break
        got[min(left, key=lambda c: ((got[c] + 0.5) / shares[c], c))] += 1
    return got


def eligible_records(test: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, condition): test ids with a subjective that isn't blank and a label with a condition, once each.

    Ids with several conditions keep the smallest; a blank condition is one of its own; null ids are left out; columns of the two
    tables with the same names don't clash, only id, subjective and condition are read.
    """
    usable = test.filter(F.col("id").isNotNull() & F.col("subjective").rlike(r"(?U)\S")).select("id").distinct()
    named = (
        labels.select("id", normal_condition("condition").alias("condition"))
        .filter(F.col("id").isNotNull() & F.col("condition").isNotNull())
        .groupBy("id")
        .agg(F.min("condition").alias("condition"))
    )
    return usable.join(named, "id")


class MatchedSample:
    """Sample of records (id, condition) with the shares of targets (condition, target_pct, min_rows).

    size: number of records wanted; None means a fifth of the records, rounded down. The targets
    table is small by nature: it is collected, and so is one count for each of its categories.
    Records whose category has no target are never sampled. Repeated targets of a category add
    up their shares and keep the largest minimum; null shares and minima count as 0.
    """

    def __init__(self, records: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 0):
        self.seed = seed
        wanted = (
            targets.select(normal_condition("condition").alias("condition"), "target_pct", "min_rows")
            .filter("condition is not null")
            .groupBy("condition")
            .agg(F.coalesce(F.sum("target_pct"), F.lit(0)).alias("target_pct"), F.coalesce(F.max("min_rows"), F.lit(0)).alias("min_rows"))
        )
        self.records = records.select("id", normal_condition("condition").alias("condition"))
        plan = {r["condition"]: (int(r["target_pct"]), int(r["min_rows"])) for r in wanted.collect()}
        # One row for each target and one for all other categories together.
        known = F.when(F.col("condition").isin(list(plan)), F.col("condition"))
        have = {r["c"]: r["n"] for r in self.records.groupBy(known.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
        everything = sum(have.values())
        have = {c: have.get(c, 0) for c in plan}
        self.rows = []
        self.size = everything // 5 if size is None else size
        self.seats = divisor_seats(have, {c: p for c, (p, _) in plan.items()}, {c: m for c, (_, m) in plan.items()}, self.size)
        for c, (pct, floor) in sorted(plan.items()):
            self.rows.append((c, pct, floor, max(floor, -(-pct * self.size // 100)), self.seats[c]))
        self.spark = records.sparkSession

    def _plan(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "condition string, target_pct int, min_rows int, wanted bigint, seats bigint")

    def sequence(self) -> DataFrame:
        """(id, condition, rank, priority, wanted, seats): the records of all targets in the order in which they are taken: by rank inside the condition,
        by priority across conditions (null where the share is 0). wanted: seats the target asks for; seats: what it gets."""
        ranked = hash_rank(self.records.join(F.broadcast(self._plan()), "condition"), ["condition"], ["id"], "rank", self.seed)
        priority = F.when(F.col("target_pct") > 0, (F.col("rank") - 0.5) / F.col("target_pct"))
        return ranked.select("id", "condition", "rank", priority.alias("priority"), "wanted", "seats")

    def report(self) -> DataFrame:
        """One row per target: available, wanted, taken and two shortfalls, all read off the sequence.

        wanted is the larger of min_rows and the share of the size. short_by: how many of the wanted seats come after the last record of the condition, which
        is exhausted then, so the target can't be met. missing: how many of the wanted seats the sample didn't give, also because the minima of others came first.
        """
        got = self.sequence().groupBy("condition").agg(
            F.max("rank").alias("available"), F.count(F.when(F.col("rank") <= F.col("wanted"), 1)).alias("_filled"), F.count(F.when(F.col("rank") <= F.col("seats"), 1)).alias("taken")
        )
        zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
        return self._plan().join(got, "condition", "left").select(
            "condition", "target_pct", "min_rows", zero("available").alias("available"), "wanted", zero("taken").alias("taken"),
            (F.col("wanted") - zero("_filled")).alias("short_by"), F.greatest(F.col("wanted") - zero("taken"), F.lit(0)).cast("bigint").alias("missing"),
        )

    def sample(self) -> DataFrame:
        """The sampled records with their condition, the rank in it and the priority by which they were kept."""
        return self.sequence().filter("rank <= seats").select("id", "condition", "rank", "priority")
