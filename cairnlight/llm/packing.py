"""Items packed into containers of a fixed capacity (problem 7)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.operators.ranking import hash_rank

#: Large items are rounded up to 1/CLASSES of a container for planning, so the plan always fits. Items of up to SMALL such steps are rounded up to 1/64 of their own
#: magnitude (exact below 128), so that many small items don't waste room; the number of classes stays bounded by the logarithm of the capacity.
CLASSES, SMALL = 512, 16
#: A shallow combination joins at most this many items and leaves at most WINDOW classes unused.
DEPTH, WINDOW = 3, 4


def combinations(units: int, present: list[int]) -> np.ndarray:
    """Rows of up to DEPTH class numbers (0: none), largest first, whose sum fills the window [units - WINDOW, units]."""
    have = np.array(sorted(set(present)), dtype=np.int64)
    held = np.zeros(units + 1, dtype=bool)
    held[have] = True
    out = [(a, 0, 0) for a in have if a >= units - WINDOW]
    for a in have:
        for b in have[have <= min(a, units - a)]:
            if a + b >= units - WINDOW:
                out.append((a, b, 0))
            low, high = max(1, units - WINDOW - a - b), min(b, units - a - b)
            out += [(a, b, c) for c in range(low, high + 1) if held[c]]
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def nonnegative_least_squares(rows: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that brings the class counts of sum x_j * combination_j close to target, by accelerated projected gradients.

    rows: combinations as class numbers (0: none). Classes are weighted by their length, so that long
    items, which are hard to place, fit best.
    """
    n, width = len(rows), len(target)
    weight = np.arange(width, dtype=float)

    def apply(x: np.ndarray) -> np.ndarray:
        y = np.zeros(width)
        for k in range(rows.shape[1]):
            y += np.bincount(rows[:, k], weights=x, minlength=width)
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[rows].sum(axis=1)

    probe = np.ones(n)
    scale = 1.0
    for _ in range(20):
        probe = back(weight * apply(probe))
        scale = np.linalg.norm(probe) or 1.0
        probe /= scale
    x = z = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - back(weight * (apply(z) - target)) / scale)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def length_class(size: int, capacity: int) -> int:
    """The length, at least size and at most capacity, as which an item of this size is planned."""
    step = -(-capacity // CLASSES)
    grain = step if size > SMALL * step else max(1, 1 << max(0, size.bit_length() - 7))
    return min(capacity, -(-size // grain) * grain)


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(items of each class in a container, number of such containers) for a histogram of length classes.

    First the shallow combinations of large classes, repeated as often as the least squares solution says, rounded down
    and never beyond what is there; the room they leave is filled with small items where there are enough. What remains is packed greedily: the longest class first, then always
    the longest class that still fits; such a pattern is repeated as long as all its classes last, so the
    work depends on the number of classes, not of items.
    """
    step = -(-capacity // CLASSES)
    units = capacity // step
    lengths = np.array(sorted(c for c, n in histogram.items() if n > 0), dtype=np.int64)
    left = np.array([histogram[int(c)] for c in lengths], dtype=np.int64)
    at = {int(c): i for i, c in enumerate(lengths)}
    small = [int(c) for c in lengths[::-1] if c <= SMALL * step]
    plan: list[tuple[dict[int, int], int]] = []

    def add(need: dict[int, int], times: int) -> None:
        plan.append((need, times))
        for c, k in need.items():
            left[at[c]] -= k * times

    coarse = {int(c) // step: int(c) for c in lengths if c > SMALL * step and c % step == 0}
    rows = combinations(units, list(coarse)) if coarse else np.zeros((0, 3), dtype=np.int64)
    if len(rows):
        target = np.zeros(units + 1)
        for u, c in coarse.items():
            target[u] = left[at[c]]
        x = nonnegative_least_squares(rows, target)
        for j in np.argsort(-x, kind="stable").tolist():
            need: dict[int, int] = {}
            for u in rows[j].tolist():
                if u:
                    need[coarse[u]] = need.get(coarse[u], 0) + 1
            times = min([int(x[j]), *(int(left[at[c]]) // k for c, k in need.items())])
            if times > 0:
                room = capacity - sum(c * k for c, k in need.items())
                for c in small:
                    if k := min(room // c, int(left[at[c]]) // times):
                        need[c] = need.get(c, 0) + k
                        room -= c * k
                add(need, times)
    while left.any():
        room, need, free = capacity, {}, left > 0
        while True:
            fits = np.flatnonzero(free[: np.searchsorted(lengths, room, side="right")])
            if not len(fits):
                break
            i = int(fits[-1])
            c = int(lengths[i])
            need[c] = min(room // c, int(left[i]))
            free[i] = False
            room -= c * need[c]
        add(need, min(int(left[at[c]]) // k for c, k in need.items()))
    return plan


def pack(df: DataFrame, id_column: str, size_column: str, capacity: int, seed: int = 0) -> DataFrame:
    """(id, piece, start, length, container): every item in one container, cut only where it is larger than the capacity.

    A larger item first fills containers of its own, its remainder is packed like an item. container is
    null for null sizes and sizes of 0 or less (one row, piece 1, length 0): nothing is to be placed. Repeated ids
    are items of their own. Planning sees only the histogram of the length classes; each item then
    finds its container from its rank in its class, so no task or driver holds the items of a class.
    """
    spark, step = df.sparkSession, -(-capacity // CLASSES)
    magnitude = F.expr("shiftleft(1L, greatest(length(bin(rest)) - 7, 0))")
    grain = F.when(F.col("rest") > SMALL * step, F.lit(step).cast("bigint")).otherwise(magnitude)
    items = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(size_column), F.lit(0)).cast("bigint").alias("size"))
    full = F.floor(F.col("size") / capacity).cast("bigint")
    rest = F.col("size") - full * capacity
    pieces = items.filter("size > 0").select("id", "size", full.alias("full"), rest.alias("rest")).withColumn("grain", grain)
    whole = pieces.filter("full > 0").select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("full"))).alias("piece"))
    whole = whole.select("id", F.col("piece").cast("int").alias("piece"), ((F.col("piece") - 1) * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("length"))
    tails = pieces.filter("rest > 0").select(
        "id", (F.col("full") + 1).cast("int").alias("piece"), (F.col("full") * capacity).alias("start"), F.col("rest").alias("length"),
        F.least(F.expr("((rest + grain - 1) div grain) * grain"), F.lit(capacity)).cast("bigint").alias("class"),
    )
    histogram = {r["class"]: r["n"] for r in tails.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    spans: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = {}
    containers = 0
    for need, times in plan_containers(histogram, capacity):
        for c, k in need.items():
            at = used.get(c, 0)
            spans.append((c, at + 1, at + k * times, k, containers))
            used[c] = at + k * times
        containers += times
    table = spark.createDataFrame(spans, "class bigint, first bigint, last bigint, each bigint, base bigint")
    ranked = hash_rank(tails, ["class"], ["id", "piece"], "rank", seed)
    placed = (
        ranked.join(F.broadcast(table), "class")
        .filter("rank between first and last")
        .select("id", "piece", "start", "length", (F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("container"))
    )
    alone = hash_rank(whole.withColumn("_all", F.lit(0)), ["_all"], ["id", "piece"], "rank", seed).select(
        "id", "piece", "start", "length", (F.col("rank") - 1 + containers).cast("bigint").alias("container")
    )
    nothing = items.filter("size <= 0").select("id", F.lit(1).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("bigint").alias("container"))
    return placed.unionByName(alone).unionByName(nothing)


def container_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Number of containers, their contents and the unused share."""
    per = packed.filter("container is not null").groupBy("container").agg(F.sum("length").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("used"),
        F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count(F.lit(1)) * capacity), 5).alias("unused_share"),
    )
