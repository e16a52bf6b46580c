"""Train, validation and test splits that keep all records of one person together (problem 2)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.llm.sampling import normal_condition
from cairnlight.operators.components import connected_components
from cairnlight.operators.ranking import hash_rank, running_total
from cairnlight.session import written

#: Fixed value: a uuid in text.
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def patient_of(column: str | Column) -> Column:
    """The uuid at the end of an id in lower case; the whole id in lower case where there is none."""
    low = F.regexp_replace(F.lower(F.col(column) if isinstance(column, str) else column), r"(?U)^\s+|\s+$", "")
    found = F.regexp_extract(low, f"({UUID})$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), low)


def persons(labels: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, person) for each distinct non-null id: the id's patient, or the component of that patient under the merges.

    Only patients named in merges take part in the iteration; all others are persons of their own.
    """
    components = connected_components(
        merges.select(patient_of("old_patient_id").alias("src"), patient_of("new_patient_id").alias("dst"))
    ).select(F.col("node").alias("patient"), F.col("component"))
    ids = labels.filter("id is not null").select("id").distinct().withColumn("patient", patient_of("id"))
    return ids.join(components, "patient", "left").select("id", F.coalesce("component", "patient").alias("person"))


def related_ids(people: DataFrame) -> DataFrame:
    """(first_id, other_id) of each person with two or more ids: the smallest id against every other."""
    first = people.groupBy("person").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return people.join(first, "person").filter("id <> first_id").select("first_id", F.col("id").alias("other_id"))


def closest_subset(sizes: dict[int, int], goal: int, larger: bool = False) -> dict[int, int]:
    """How many items of each size to take so that their sum comes closest to goal (on a tie the smaller sum, or the larger one).

    Sums that can be reached are the set bits of one table up to goal and the largest size; multiplicities are split into powers of two. Each sum keeps
    the part by which it was first reached, and the choice is read back along these: a part that first reaches a sum stands on one reached by earlier parts.
    """
    parts: list[tuple[int, int]] = []
    for size, n in sorted(sizes.items()):
        k = 1
        while n > 0:
            take = min(k, n)
            parts.append((size, take))
            n, k = n - take, k * 2
    goal = max(0, goal)
    top = min(sum(s * k for s, k in parts), goal + max(sizes, default=0))
    first = np.full(top + 1, -1, dtype=np.int32)  # -1: not reached
    reached = np.zeros(top + 1, dtype=bool)
    reached[0] = True
    for i, (size, take) in enumerate(parts):
        w = size * take
        if w <= top:
            new = np.flatnonzero(reached[: top + 1 - w] & ~reached[w:]) + w
            reached[new], first[new] = True, i
    sums = np.flatnonzero(reached)
    sums = sums[::-1] if larger else sums
    best = int(sums[np.argmin(np.abs(sums - goal))])  # the first of two that are equally close
    chosen: dict[int, int] = {}
    while best:
        size, take = parts[first[best]]
        chosen[size] = chosen.get(size, 0) + take
        best -= size * take
    return chosen


def plan_stratum(sizes: dict[int, int], goals: dict[str, int], shares: dict[str, float], table: int = 1 << 24, larger: bool = False) -> list[tuple[int, str, int, int]]:
    """(size, split, first, last) ranks of a stratum's persons of each size: who goes where.

    sizes: number of persons by size. Of each size every split first gets its part, rounded down, of all persons but a reserve that is large
    enough to make up for the largest person; the reserve is dealt by subset sums so that each split's total comes closest to its goal. The last split, which has no goal, takes
    what is left. larger: which of two equally close sums is taken; strata should differ in it, or ties add up. table is the longest table of sums: where the reserve of a stratum holds more records (persons of tens of thousands of ids), sums are compared in units of several records.
    """
    names = list(shares)
    largest = max(sizes)
    dealt = {s: max(0, n - -(-2 * largest // s)) for s, n in sizes.items()}
    taken = {name: {s: int(n * shares[name]) for s, n in dealt.items()} for name in names}
    left = {s: n - sum(taken[name][s] for name in names) for s, n in sizes.items()}
    unit = -(-sum(s * n for s, n in left.items()) // table) or 1
    for name in names[:-1]:
        coarse: dict[int, list[int]] = {}
        for s in sorted(left):
            coarse.setdefault(max(1, round(s / unit)), []).append(s)
        wanted = goals[name] - sum(s * k for s, k in taken[name].items())
        more = closest_subset({c: sum(left[s] for s in group) for c, group in coarse.items()}, round(wanted / unit), larger)
        for c, k in more.items():
            for s in coarse[c]:
                now = min(k, left[s])
                taken[name][s] += now
                left[s] -= now
                k -= now
    for s, k in left.items():
        taken[names[-1]][s] += k
    out = []
    for s in sorted(sizes):
        start = 1
        for name in names:
            if k := taken[name][s]:
                out.append((s, name, start, start + k - 1))
                start += k
    return out


def assign_splits(people: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """(id, person, condition, split): every id once, all ids of a person in one split.

    shares: split -> share, in the order of dealing, the last takes the remainder (default test 0.15,
    validation 0.15, train 0.7). A person's stratum is the commonest condition of the ids (ties: the
    smallest). The goals of a stratum are the share of the records up to it in the order of a hash, rounded, less that of the records before it: so they add up
    to the overall goals whatever the number of strata, and each is within two records of the stratum's own share. Every stratum is planned by a task of its own from
    its number of persons by size; nothing goes to the driver.
    """
    shares = shares or {"test": 0.15, "validation": 0.15, "train": 0.7}
    named = labels.filter("id is not null").groupBy("id").agg(F.min(normal_condition("condition")).alias("condition"))
    rows = people.join(named, "id", "left").withColumn("condition", F.coalesce("condition", F.lit("")))
    per = rows.groupBy("person", "condition").agg(F.count(F.lit(1)).alias("n"))
    stratum = written(per.groupBy("person").agg(
        F.min(F.struct((-F.col("n")).alias("a"), F.col("condition").alias("stratum")))["stratum"].alias("stratum"),
        F.sum("n").alias("size"),
    ))
    counts = stratum.groupBy("stratum", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("stratum").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    upto = running_total(totals, [], "total", ["stratum"], "upto", seed)
    names = list(shares)
    goals, before, after, rest = [], F.col("upto") - F.col("total"), F.col("upto"), 1.0
    for name in names:  # each split has its part of the records that no split before it has, so no two want the same record
        part = min(1.0, shares[name] / rest) if rest > 0 else 0.0
        a, b = (F.floor(x * part + 0.5).cast("bigint") for x in (before, after))
        goals.append(b - a)
        before, after, rest = before - a, after - b, rest - shares[name]
    wanted = counts.join(upto.select("stratum", F.array(*goals).alias("goals")), "stratum")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = dict(zip(pdf["size"].tolist(), pdf["n"].tolist()))
        found = plan_stratum(sizes, dict(zip(names, pdf["goals"].iloc[0])), shares, larger=bool(zlib.crc32(pdf["stratum"].iloc[0].encode()) & 1))
        return pd.DataFrame([(pdf["stratum"].iloc[0], *x) for x in found], columns=["stratum", "size", "split", "first", "last"])

    planned = wanted.groupBy("stratum").applyInPandas(plan, "stratum string, size bigint, split string, first bigint, last bigint")
    ranked = hash_rank(stratum, ["stratum", "size"], ["person"], "rank", seed)
    dealt = ranked.join(planned, ["stratum", "size"]).filter("rank between first and last").select("person", "split")
    return rows.join(dealt, "person").select("id", "person", F.nullif("condition", F.lit("")).alias("condition"), "split")


def split_report(assigned: DataFrame) -> DataFrame:
    """Records and share of each split, overall (condition 'all') and per condition."""
    pairs = assigned.select(F.explode(F.array(F.lit("all"), F.coalesce("condition", F.lit("none")))).alias("condition"), "split")
    n = pairs.groupBy("condition", "split").agg(F.count(F.lit(1)).alias("records"))
    total = n.groupBy("condition").agg(F.sum("records").alias("_all"))
    return n.join(total, "condition").select("condition", "split", "records", F.round(F.col("records") / F.col("_all"), 4).alias("share"))
