import random

import pytest

from cairnlight.llm.sampling import MatchedSample, divisor_seats, eligible_records
from cairnlight.llm.splits import assign_splits, closest_subset, patient_of, persons, plan_stratum, related_ids, split_report

U = "00000000-0000-0000-0000-{:012d}"


def plain_seats(have, shares, floors, size):
    seats = {c: min(floors.get(c, 0), have.get(c, 0)) for c in shares}
    size = max(sum(seats.values()), min(size, sum(have.get(c, 0) for c in shares)))
    while sum(seats.values()) < size:
        free = [c for c in shares if shares[c] > 0 and seats[c] < have.get(c, 0)]
        if not free:
            break
        seats[min(free, key=lambda c: ((seats[c] + 0.5) / shares[c], c))] += 1
    return seats


def test_seats_equal_one_by_one():
    rng = random.Random(3)
    for _ in range(300):
        names = [f"c{i}" for i in range(rng.randint(1, 7))]
        have = {c: rng.choice([0, 1, 3, 50, 400]) for c in names}
        shares = {c: rng.choice([0, 1, 5, 20]) for c in names}
        floors = {c: rng.choice([0, 2, 8]) for c in names}
        size = rng.randint(0, 500)
        assert divisor_seats(have, shares, floors, size) == plain_seats(have, shares, floors, size)


def frames(spark, test, labels):
    return (
        spark.createDataFrame(test, "id string, subjective string, objective string, source string"),
        spark.createDataFrame(labels, "id string, condition string, source string"),
    )


def test_eligible_cases(spark):
    test, labels = frames(
        spark,
        [("a", "x", None, "s"), ("a", "x", None, "s"), ("b", "  \t", None, "s"), ("c", None, None, "s"), ("d", "y", None, "s"), (None, "z", None, "s"), ("e", "w", None, "s")],
        [("a", " Flu\t", "l"), ("a", "flu", "l"), ("b", "flu", "l"), ("c", "flu", "l"), ("d", None, "l"), (None, "flu", "l"), ("e", "  ", "l"), ("x", "flu", "l")],
    )
    assert sorted(tuple(r) for r in eligible_records(test, labels).collect()) == [("a", "flu"), ("e", "")]


def test_sample_meets_targets_and_reports(spark):
    records = spark.createDataFrame([(f"{c}{i}", c) for c, n in (("big", 300), ("small", 12), ("other", 88)) for i in range(n)], "id string, condition string")
    targets = spark.createDataFrame([("big", 50, 5), ("SMALL ", 40, 4), ("gone", 10, 3), (None, 1, 1)], "condition string, target_pct int, min_rows int")
    s = MatchedSample(records, targets)
    report = {r.condition: r for r in s.report().collect()}
    assert s.size == 80
    assert (report["small"].available, report["small"].wanted, report["small"].taken, report["small"].short_by) == (12, 32, 12, 20)
    assert report["gone"].short_by == 8 and report["big"].short_by == 0
    got = s.sample().collect()
    assert len(got) == len({r.id for r in got}) == 80 and sum(r.condition == "big" for r in got) == 68
    assert sorted(map(tuple, s.sample().collect())) == sorted(map(tuple, got))


def test_sample_of_nothing(spark):
    none = spark.createDataFrame([], "id string, condition string")
    targets = spark.createDataFrame([("a", 100, 2)], "condition string, target_pct int, min_rows int")
    s = MatchedSample(none, targets)
    assert s.sample().count() == 0 and s.report().first().short_by == 2
    assert MatchedSample(none, targets.limit(0)).report().count() == 0


def test_patients(spark):
    df = spark.createDataFrame([("flu_" + U.format(1).upper(),), ("nota_flu_" + U.format(1),), ("odd ID",), (None,)], "id string")
    assert [r[0] for r in df.select(patient_of("id")).collect()] == [U.format(1), U.format(1), "odd id", None]


def people(spark):
    labels = [(f"c{i % 3}_{U.format(i // 2)}", f"c{i % 3}") for i in range(60)] + [(f"C0_{U.format(0).upper()}", None), (None, "c0"), ("c1_" + U.format(5), "c1")]
    merges = [(U.format(0), U.format(1)), (U.format(900), U.format(1).upper()), (U.format(900), U.format(3)), (U.format(900), U.format(3)), (None, U.format(4)), (U.format(7), U.format(7))]
    df = spark.createDataFrame(labels, "id string, condition string")
    return df, persons(df, spark.createDataFrame(merges, "old_patient_id string, new_patient_id string"))


def test_persons_through_chains(spark):
    _, who = people(spark)
    got = {r.id: r.person for r in who.collect()}
    joined = {p for i, p in got.items() if i.lower().endswith((U.format(0), U.format(1), U.format(3)))}
    assert joined == {U.format(0)}
    assert len(set(got.values())) == 28
    pairs = {tuple(r) for r in related_ids(who).collect()}
    first = min(i for i, p in got.items() if p == U.format(0))
    assert {b for a, b in pairs if a == first} == {i for i, p in got.items() if p == U.format(0)} - {first}


def test_splits_keep_persons_together(spark):
    labels, who = people(spark)
    got = assign_splits(who, labels).collect()
    assert len(got) == len({r.id for r in got}) == who.count()
    split = {}
    for r in got:
        assert split.setdefault(r.person, r.split) == r.split
    shares = {r.split: r.share for r in split_report(assign_splits(who, labels)).filter("condition = 'all'").collect()}
    assert abs(shares["train"] - 0.7) < 0.07 and abs(shares["test"] - 0.15) < 0.07


def test_splits_of_nothing(spark):
    labels = spark.createDataFrame([], "id string, condition string")
    who = persons(labels, spark.createDataFrame([], "old_patient_id string, new_patient_id string"))
    assert assign_splits(who, labels).count() == 0 and related_ids(who).count() == 0


def test_closest_subset_against_all_subsets():
    rng = random.Random(5)
    for _ in range(200):
        sizes = {rng.randint(1, 9): rng.randint(1, 3) for _ in range(rng.randint(0, 4))}
        goal = rng.randint(0, 40)
        sums = {0}
        for s, n in sizes.items():
            sums = {a + s * k for a in sums for k in range(n + 1)}
        got = closest_subset(dict(sizes), goal)
        assert all(k <= sizes[s] for s, k in got.items())
        assert abs(sum(s * k for s, k in got.items()) - goal) == min(abs(x - goal) for x in sums)
        more = closest_subset(dict(sizes), goal, larger=True)
        assert sum(s * k for s, k in more.items()) in {sum(s * k for s, k in got.items()), 2 * goal - sum(s * k for s, k in got.items())}


@pytest.mark.parametrize("hot", [1, 400])
def test_plan_covers_everybody_once(hot):
    shares = {"test": 0.15, "validation": 0.15, "train": 0.7}
    for sizes in ({1: 1000, 2: 33, hot: 1}, {3: 7}, {1: 1}):
        total = sum(s * n for s, n in sizes.items())
        goals = {k: round(v * total) for k, v in shares.items()}
        plan = plan_stratum(sizes, goals, shares)
        for size, n in sizes.items():
            assert sorted(x for z, _, a, b in plan if z == size for x in range(a, b + 1)) == list(range(1, n + 1))
        test = sum(z * (b - a + 1) for z, name, a, b in plan if name == "test")
        assert abs(test - goals["test"]) <= (0 if len(sizes) > 1 else 1)


def test_many_sizes_stay_small():
    """A thousand sizes of persons: the table of sums stays far below 200 MB and the goal is met."""
    import tracemalloc

    sizes, shares = {s: 1 for s in range(1, 1001)}, {"test": 0.15, "validation": 0.15, "train": 0.7}
    tracemalloc.start()
    plan = plan_stratum(sizes, {"test": 75075, "validation": 75075, "train": 0}, shares)
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
    assert sum(z * (b - a + 1) for z, name, a, b in plan if name == "test") == 75075


def test_many_strata_meet_the_shares(spark):
    """Conditions that all differ: no stratum can be shared out, the whole can."""
    labels = spark.createDataFrame([(f"x_{U.format(i)}", f"condition {i}") for i in range(3000)], "id string, condition string")
    who = persons(labels, spark.createDataFrame([], "old_patient_id string, new_patient_id string"))
    n = {r.split: r["count"] for r in assign_splits(who, labels).groupBy("split").count().collect()}
    assert abs(n["test"] - 450) <= 1 and abs(n["validation"] - 450) <= 1 and sum(n.values()) == 3000
