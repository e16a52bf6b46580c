"""Cohorts from dated events: cutoffs, history filters, matching, screening, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.functions.stats import two_proportion_z
from cairnlight.operators.ranking import hash_rank


def first_dates(events: DataFrame, key: str, day: Column, target: Column) -> DataFrame:
    """(key, cutoff): the earliest day of a target event; events without a day and keys without a target are left out."""
    rows = events.filter(target).select(F.col(key), day.alias("_d")).filter(F.col(key).isNotNull() & F.col("_d").isNotNull())
    return rows.groupBy(key).agg(F.min("_d").alias("cutoff"))


def pulled_cutoffs(cutoffs: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Cutoffs moved to the earliest of further (key, cutoff) rows; these never add a key."""
    more = others[0]
    for o in others[1:]:
        more = more.unionByName(o)
    earliest = more.groupBy(key).agg(F.min("cutoff").alias("_other"))
    return cutoffs.join(earliest, key, "left").select(key, F.least("cutoff", "_other").alias("cutoff"))


def first_target_row(events: DataFrame, key: str, day: str, payload: list[str], order: list[str]) -> DataFrame:
    """Payload of the first event per key by day, then by order; a partial min, so no group meets in one task before it is small."""
    packed = F.struct(day, *order, *payload)
    first = events.filter(F.col(day).isNotNull()).groupBy(key).agg(F.min(packed).alias("_f"))
    return first.select(key, F.col(f"_f.{day}").alias("cutoff"), *[F.col(f"_f.{c}").alias(c) for c in payload])


def before_cutoff(events: DataFrame, cutoffs: DataFrame, key: str, day: Column) -> DataFrame:
    """Events strictly before their key's cutoff; keys without a cutoff keep everything, events without a day are kept too."""
    joined = events.withColumn("_day", day).join(cutoffs.select(key, "cutoff"), key, "left")
    keep = F.col("cutoff").isNull() | F.col("_day").isNull() | (F.col("_day") < F.col("cutoff"))
    return joined.filter(keep).drop("_day", "cutoff")


def blanked_after(value: Column, day: Column, cutoff: Column) -> Column:
    """The value, or an empty text where its day isn't before the cutoff."""
    return F.when(cutoff.isNotNull() & day.isNotNull() & (day >= cutoff), F.lit("")).otherwise(value)


def without_linked(events: DataFrame, dropped: DataFrame, link: str, id_column: str = "id") -> DataFrame:
    """Events whose link isn't among the dropped rows; a null link is kept."""
    return events.join(dropped.select(F.col(id_column).alias(link)).distinct(), link, "left_anti")


def quarantine(rows: DataFrame, key: str, text: str, parsed: Column) -> DataFrame:
    """(key, problem): for keys with a day that is given but can't be read, the smallest such text."""
    bad = rows.filter(F.col(text).isNotNull() & (F.trim(text) != "") & parsed.isNull() & F.col(key).isNotNull())
    return bad.groupBy(key).agg(F.min(text).alias("problem"))


def range_bounds(df: DataFrame, order: str, buckets: int = 64) -> list:
    """Bounds of range buckets of a column, from the 16 * buckets rows with the smallest hashes: a bounded sample that only decides how even the buckets are."""
    sample = df.filter(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(16 * buckets).collect()
    values = sorted(r[0] for r in sample)
    return sorted({values[i * len(values) // buckets] for i in range(1, buckets)}) if values else []


def ordered_rank(df: DataFrame, group: list[str], order: str, rank: str, bounds: list | None = None) -> DataFrame:
    """1-based rank by a column within group (nulls first), through range buckets, so that a hot group is many tasks.

    bounds: those of range_bounds, taken from df where none are given. Any bounds give the same ranks, since the sizes of the buckets are counted.
    """
    bounds = range_bounds(df, order) if bounds is None else bounds
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<string>")
    keyed = df.withColumn("_b", F.size(F.filter(edges, lambda b: b <= F.col(order))))
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(order))
    return keyed.withColumn("_i", inside).join(offsets, [*group, "_b"]).withColumn(rank, (F.col("_i") + F.col("_o")).cast("bigint")).drop("_b", "_i", "_o")


def matched_controls(positives: DataFrame, others: DataFrame, key: str, strata: list[str], each: int = 3) -> DataFrame:
    """(control, positive): up to `each` controls for a positive with the same strata, without replacement, both in order of the key.

    The n-th control of a stratum goes to positive ceil(n / each): a join of two ranks instead of a loop.
    """
    bounds = range_bounds(others, key)
    p = ordered_rank(positives.select(key, *strata), strata, key, "_slot", bounds).withColumnRenamed(key, "positive")
    n = ordered_rank(others.select(key, *strata), strata, key, "_rank", bounds).withColumnRenamed(key, "control")
    n = n.withColumn("_slot", F.floor((F.col("_rank") - 1) / each) + 1)
    return n.join(p, [*strata, "_slot"]).select("control", "positive", *strata)


def nearest_controls(positives: DataFrame, others: DataFrame, key: str, group: str, value: str, width: int = 10, each: int = 3) -> DataFrame:
    """(control, positive): greedy matching within group on |difference of value| <= width, without replacement.

    Positives come in order of their key; each takes the closest free controls (ties: the lower value, then the key).
    The result depends on the order, so a group is one sequential fold; split large groups by further strata.
    """

    def fold(keys: tuple, left, right):
        import bisect

        import pandas as pd

        free = sorted(zip(right[value], right[key]))
        out = []
        for k, v in sorted(zip(left[key], left[value])):
            a = bisect.bisect_left(free, (v - width,))
            b = bisect.bisect_right(free, (v + width, chr(0x10FFFF)))
            for x in sorted(free[a:b], key=lambda f: (abs(f[0] - v), f[0], f[1]))[:each]:
                free.remove(x)
                out.append((x[1], k))
        return pd.DataFrame(out, columns=["control", "positive"])

    # Both sides may come from one table: fresh columns keep them apart.
    left_side, right_side = (x.select(key, group, value).toDF(key, group, value) for x in (positives, others))
    return left_side.groupBy(group).cogroup(right_side.groupBy(group)).applyInPandas(fold, "control string, positive string")


def contingency(features: DataFrame, cases: DataFrame, key: str, feature: str, positive: str) -> DataFrame:
    """Per feature the positive and negative keys that have it, with both totals; features: distinct (key, feature)."""
    has = F.col(positive).cast("int")
    per = features.join(cases, key).groupBy(feature).agg(F.sum(has).alias("n_pos_with"), F.sum(1 - has).alias("n_neg_with"))
    totals = cases.agg(F.sum(has).alias("n_pos"), F.sum(1 - has).alias("n_neg"))
    return per.join(F.broadcast(totals))  # one row


def screen(table: DataFrame, feature: str) -> DataFrame:
    """Shares and z of a contingency table."""
    z = two_proportion_z(F.col("n_pos_with"), F.col("n_pos"), F.col("n_neg_with"), F.col("n_neg"))
    return table.select(
        feature, "n_pos_with", "n_neg_with", (F.col("n_pos_with") / F.col("n_pos")).alias("p_pos"), (F.col("n_neg_with") / F.col("n_neg")).alias("p_neg"), z.alias("z")
    )


def picked_episode(diagnoses: DataFrame, episodes: DataFrame, key: str, day: str, begin: str, window_days: int) -> DataFrame:
    """Per diagnosis the latest episode that began on or before it within the window, else the latest before; the distance says which."""
    pairs = diagnoses.join(episodes, key).filter(F.col(begin) <= F.col(day))
    latest = pairs.groupBy(key, day).agg(F.max(begin).alias("episode"))
    gap = F.datediff(F.col(day), F.col("episode"))
    return latest.select(key, day, "episode", gap.alias("distance"), (gap <= window_days).alias("in_window"))


def stratified_split(records: DataFrame, key: str, stratum: str, shares: list[tuple[str, int]], seed: int | None = 0) -> DataFrame:
    """(key, stratum, split) with shares in percent per stratum, by rank of a hash; without a seed by the order of the key itself."""
    rows = records.select(key, stratum)
    ranked = ordered_rank(rows, [stratum], key, "_r") if seed is None else hash_rank(rows, [stratum], [key], "_r", seed)
    sizes = records.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    split, upto = F.lit(None).cast("string"), 0
    place = (F.col("_r") - 1) * 100 / F.col("_n")
    for name, pct in reversed(shares):
        upto += pct
        split = F.when(place < 100 - upto + pct, F.lit(name)).otherwise(split)
    return ranked.join(sizes, stratum).select(key, stratum, split.alias("split"))


def rolling_history(events: DataFrame, key: str, day: str, years: int) -> DataFrame:
    """Events of the last `years` years before the key's latest event (the 29th to 31st count as the 28th)."""
    last = events.groupBy(key).agg(F.max(day).alias("_last"))
    start = F.make_date(F.year("_last") - years, F.month("_last"), F.least(F.dayofmonth("_last"), F.lit(28)))
    return events.join(last, key).filter(F.col(day) >= start).drop("_last")
