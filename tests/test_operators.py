import math
import random

import pytest
from pyspark.sql import functions as F

from cairnlight.functions import metrics, stats
from cairnlight.functions.dates import age_on, local_date, relative_time, shifted_birthday
from cairnlight.functions.text import sentences, token_chunks, tokens
from cairnlight.operators import cohort as C
from cairnlight.operators import knowledge as K
from cairnlight.operators.components import connected_components
from cairnlight.operators.ranking import hash_rank, running_total


def test_hash_rank_is_a_permutation_of_each_group(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 500), ("b", 3), (None, 7)) for i in range(n)], "g string, id int")
    got = hash_rank(df, ["g"], ["id"]).collect()
    for g, n in (("a", 500), ("b", 3), (None, 7)):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(1, n + 1))


def test_running_total(spark):
    df = spark.createDataFrame([("a", i, i % 7) for i in range(300)], "g string, id int, v int")
    got = running_total(df, ["g"], "v", ["id"], "t").collect()
    assert max(r["t"] for r in got) == sum(i % 7 for i in range(300))
    assert len({(r["t"], r["id"]) for r in got}) == 300


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("case", ["chain", "random", "star", "loops"])
def test_components(spark, case):
    rng = random.Random(1)
    edges = {
        "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(120)],
        "random": [(f"n{rng.randrange(150):03}", f"n{rng.randrange(150):03}") for _ in range(110)],
        "star": [("hub", f"n{i:03}") for i in range(100)] + [("hub", "n001")],
        "loops": [("a", "a"), ("b", "c"), ("c", "b"), ("b", "c")],
    }[case]
    df = spark.createDataFrame([*edges, (None, "x"), ("y", None)], "src string, dst string")
    assert {r.node: r.component for r in connected_components(df).collect()} == brute_components(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2024-03-01T23:30:00-02:00",), ("01/02/2024",), ("2024-13-01",), (None,)], "t string")
    got = [str(r[0]) for r in df.select(local_date("t")).collect()]
    assert got == ["2024-02-29", "2024-03-02", "None", "None", "None"]
    day = lambda s: F.lit(s).cast("date")
    row = spark.range(1).select(
        age_on(day("2000-02-29"), day("2023-02-28")), age_on(day("2000-02-29"), day("2023-03-01")), shifted_birthday(day("2000-02-29"), F.lit(1), day("2030-01-01")),
        relative_time(day("2024-01-01"), day("2024-01-02")), relative_time(day("2024-01-01"), day("2024-02-01")), relative_time(day("2024-01-01"), day("2026-01-01")),
    ).first()
    assert [str(x) for x in row] == ["22", "23", "2001-02-28", "1 day ago", "1 month ago", "2 years ago"]


def test_matched_controls_last_group_short(spark):
    people = [(f"p{i}", 1990) for i in range(2)] + [("q", 2000)]
    others = [(f"c{i}", 1990) for i in range(7)] + [("d", 1980)]
    got = C.matched_controls(spark.createDataFrame(people, "patient string, y int"), spark.createDataFrame(others, "patient string, y int"), "patient", ["y"])
    assert sorted((r.control, r.positive) for r in got.collect()) == [("c0", "p0"), ("c1", "p0"), ("c2", "p0"), ("c3", "p1"), ("c4", "p1"), ("c5", "p1")]


def test_nearest_controls(spark):
    pos = spark.createDataFrame([("p1", "m", 1990), ("p2", "m", 1991)], "k string, g string, y int")
    oth = spark.createDataFrame([("a", "m", 1991), ("b", "m", 1989), ("c", "m", 1970), ("d", "f", 1990)], "k string, g string, y int")
    got = sorted(tuple(r) for r in C.nearest_controls(pos, oth, "k", "g", "y", 10, 1).collect())
    assert got == [("a", "p2"), ("b", "p1")]


def test_cutoff_filters_keep_keys_without_cutoff(spark):
    events = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-02"), ("a", None), ("b", "2025-01-01")], "k string, t string")
    cut = spark.createDataFrame([("a", "2024-01-02")], "k string, cutoff string").withColumn("cutoff", F.col("cutoff").cast("date"))
    got = sorted((r.k, str(r.t)) for r in C.before_cutoff(events, cut, "k", local_date("t")).collect())
    assert got == [("a", "2024-01-01"), ("a", "None"), ("b", "2025-01-01")]


def test_student_and_normal_tails():
    for t, df, p in ((2.228139, 10, 0.05), (12.7062, 1, 0.05), (1.959964, 1e7, 0.05), (3.169273, 10, 0.01)):
        assert math.isclose(stats.t_two_sided(t, df), p, rel_tol=1e-4)
    assert math.isclose(stats.t_quantile(0.975, 10), 2.228139, rel_tol=1e-5)


def test_cluster_t_cases(spark):
    data = [("ok", c, v) for c, v in ((1, 0.1), (1, 0.3), (2, -0.2), (3, 0.4), (3, None))] + [("flat", c, 0.5) for c in range(3)] + [("one", 1, 0.2)]
    got = {r.g: r for r in stats.cluster_t(spark.createDataFrame(data, "g string, c int, d double"), ["g"], "c", "d").collect()}
    assert got["flat"].status == "zero_variance" and got["one"].status == "insufficient"
    mean = 0.6 / 4
    squares = sum(x * x for x in (0.4 - 2 * mean, -0.2 - mean, 0.4 - mean))
    assert math.isclose(got["ok"].t, mean / math.sqrt(squares / 16 * 3 / 2), rel_tol=1e-9)


def test_holm_keeps_the_place_of_missing(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", None), ("f", "c", 0.02)], "f string, t string, p double")
    got = {r.t: r.p_holm for r in stats.holm(df, ["f"], "p", ["t"]).collect()}
    assert got["b"] is None and math.isclose(got["a"], 0.03) and math.isclose(got["c"], 0.04)


def test_chunks(spark):
    for n in (0, 4, 5, 6, 9, 13):
        text = " ".join(f"w{i}" for i in range(n))
        got = spark.createDataFrame([(text,)], "t string").select(token_chunks(tokens("t"), 5, 1).alias("c")).first()["c"]
        want, at = [], 0
        words = text.split()
        while at < n:
            want.append(words[at : at + 5])
            if at + 5 >= n:
                break
            at += 4
        assert got == want


def test_sentences(spark):
    row = spark.createDataFrame([("One. Two!  Three\nFour",)], "t string").select(sentences("t").alias("s")).first()
    assert row["s"] == ["One.", "Two!", "Three", "Four"]


def test_graph_self_loop_and_both_directions(spark):
    e = spark.createDataFrame([("a", "b", 1, 0), ("b", "a", 5, 1), ("c", "c", 2, 2)], "source string, target string, weight int, o int")
    edges = K.canonical_edges(e, "o")
    assert sorted(tuple(r) for r in edges.collect()) == [("a", "b", 5), ("c", "c", 2)]
    assert {r.title: r.degree for r in K.degrees(edges).collect()} == {"a": 1, "b": 1, "c": 2}


def test_batches(spark):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate([3, 3, 5, 9, 1, 1])] + [("h", 0, 4)], "g string, o int, c bigint")
    got = sorted((r.g, r.o, r.batch) for r in K.greedy_batches(df, "g", "o", "c", 6).collect())
    assert got == [("g", 0, 0), ("g", 1, 0), ("g", 2, 1), ("g", 3, 2), ("g", 4, 3), ("g", 5, 3), ("h", 0, 0)]


def test_metrics():
    a = "the cat sat on the mat".split()
    assert metrics.bleu(a, a) == 1 and metrics.rouge_l(a, a) == 1 and metrics.rouge_n(a, a, 2) == 1
    assert metrics.common_subsequence(list("ABCBDAB"), list("BDCABA")) == 4
    assert metrics.bleu(["x"], a) == 0 and metrics.meteor([], a) == 0
    assert 0.9 < metrics.meteor(a, a) <= 1


def test_scorer_faults_are_isolated(spark):
    def scorer(x, y):
        if "bad" in x:
            raise ValueError
        return [float(len(i)) for i in x]

    df = spark.createDataFrame([(1, "ok", "r"), (2, "bad", "r")], "id int, a string, b string")
    got = {r.id: (r.score, r.status) for r in metrics.scored_pairs(df, "id", "a", "b", scorer).collect()}
    assert got == {1: (2.0, "scored"), 2: (None, "error: ValueError")}


def test_global_rank(spark):
    from cairnlight.operators.ranking import global_rank

    rng = random.Random(0)
    values = [rng.choice([1.0, 2.0, 5.5, None, rng.random()]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    plain = sorted(((-1e300 if v is None else v), i) for i, v in enumerate(values))
    plain = sorted(plain, key=lambda x: (-x[0], x[1]))
    got = {r.id: r["k"] for r in global_rank(df, "v", "k", ["id"], 16).collect()}
    assert got == {i: n for n, (_, i) in enumerate(plain, 1)}
    first = {}
    for n, (v, _) in enumerate(plain, 1):
        first.setdefault(v, n)
    got = {r.id: r["k"] for r in global_rank(df, "v", "k", None, 16).collect()}
    assert got == {i: first[-1e300 if v is None else v] for i, v in enumerate(values)}
    assert global_rank(df.limit(0), "v", "k").count() == 0


def test_samples(spark):
    from cairnlight.operators.sampling import cohort_sample, quota_sample

    df = spark.createDataFrame([(f"k{i}", f"g{i % 2}") for i in range(40)], "k string, g string")
    a = [r.k for r in cohort_sample(df, "k", 7).collect()]
    assert len(set(a)) == 7 and a == [r.k for r in cohort_sample(df, "k", 7).collect()]
    before = spark.createDataFrame([("k0",), ("k2",), ("gone",)], "k string")
    quotas = spark.createDataFrame([("g0", 5), ("g1", 1), ("g2", 3)], "g string, quota int")
    got = quota_sample(df, "k", "g", quotas, before).collect()
    assert sorted(r.k for r in got if r.kept == "before") == ["k0", "k2"]
    assert sum(r.g == "g0" for r in got) == 5 and sum(r.g == "g1" for r in got) == 1
