import pytest
from pyspark.sql import functions as F

from cairnlight.operators import review as R
from cairnlight.operators.knowledge import budget_prefix, budget_top
from cairnlight.operators.probes import grouped_classes


def test_repair_keeps_first_whole_lines_in_order(spark):
    lines = [("l1", '{"id": "b", "v": "1"}'), ("l2", '{"id": "a", "v": "2"}'), ("l3", '{"id": "a", "v": "3"}'), ("l4", '{"id": "a"'), ("l5", '{"id": "z", "v": "1"}'), ("l6", '{"id": "c", "v": "1", "w": "1"}'), ("l7", ""), ("l8", None), ("l9", "[1]")]
    kept, dropped = R.repaired(spark.createDataFrame(lines, "place string, line string"), spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, ordinal int"), "line", "place", ["id", "v"])
    assert [(r.ordinal, r.line[-3:]) for r in kept.collect()] == [(1, '2"}'), (2, '1"}')]
    assert sorted(r.place for r in dropped.collect()) == ["l3", "l4", "l5", "l6", "l7", "l8", "l9"]


def test_terms_are_bounded(spark):
    few = [("a", f"t{i:02}", i / 100) for i in range(15)]
    many = [("b", f"t{i:02}", 0.9) for i in range(50)]
    rows = spark.createDataFrame(few + many, "g string, t string, s double")
    n = {r.g: r["count"] for r in R.bounded_terms(rows, "g", "t", "s", 0.5).groupBy("g").count().collect()}
    assert n == {"a": 10, "b": 30}


def test_batches_of_an_encoder(spark):
    seen = spark.sparkContext.accumulator(0)

    def encode(texts):
        assert len(texts) <= 4 and (len(texts) == 1 or sum(len(t) for t in texts) <= 50)
        seen.add(1)
        return [[float(len(t))] for t in texts]

    texts = ["x" * n for n in (10, 10, 10, 10, 10, 30, 30, 400, 1, 0)] + [None]
    df = spark.createDataFrame([("f", str(i), t) for i, t in enumerate(texts)], "field string, id string, text string").coalesce(1)
    got = {int(r.id): r.vector for r in R.embedded(df, encode, most_texts=4, most_tokens=50, tokens=len).collect()}
    assert got == {i: None if t is None else [float(len(t))] for i, t in enumerate(texts)} and seen.value == 5
    with pytest.raises(KeyError):
        R.field_texts({}, ["unknown"])


def test_verdicts(spark):
    rows = [("p1", "iron level", "x"), ("p1", "iron pills", "x"), ("p1", "cough", "x"), *[(f"q{i}", "iron level", f"c{i}") for i in range(3)], ("q9", "Iron-rich food", "c9"), ("p2", "Iron-rich food", "x")]
    signs = spark.createDataFrame(rows, "patient string, sign string, condition string")
    got = {r.sign: (r.others, r.verdict, r.words) for r in R.overlap_verdicts(signs, F.col("condition") == "x", spark.createDataFrame([("Iron deficiency (disorder)",)], "name string"), "patient", "sign", "condition").collect()}
    assert got == {"iron level": (3, "shared", ["iron"]), "iron pills": (0, "giveaway", ["iron"]), "Iron-rich food": (1, "ambiguous", ["iron"])}


def test_best_row(spark):
    rows = [("k", 1, 5, 0), ("k", 2, 1, 1), ("k", 2, 3, 2), ("k", 2, 3, 3), ("m", 0, 0, 9)]
    df = spark.createDataFrame(rows, "code string, class int, gates int, place int")
    assert {r.code: r.place for r in R.best_per_code(df, "code", F.col("class"), F.col("gates"), "place").collect()} == {"k": 2, "m": 9}


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, t string")
    b, c = spark.createDataFrame([(2, None), (1, "x"), (2, None)], "i int, t string"), spark.createDataFrame([(2, ""), (1, "x"), (2, None)], "i int, t string")
    one, two, three = (R.content_hash(x).first() for x in (a, b, c))
    assert one == two and one.digest != three.digest


@pytest.mark.parametrize("costs", [[3, 1, 4, 1, 5, 9, 2, 6], [0, 0, 7, 0, 1], [100, 1], [None, 2, 5], []])
def test_budget_top_is_the_prefix(spark, costs):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(costs)], "i int, cost int")
    want = [r.i for r in budget_prefix(df.fillna(0).withColumn("g", F.lit(0)), ["g"], [F.col("i")], "cost", 10).orderBy("i").collect()]
    assert [r.i for r in budget_top(df, [F.col("i")], "cost", 10).orderBy("i").collect()] == want


def test_classes_by_groups(spark):
    rows = [(f"g{i // 2}", "abc"[i // 2 % 3], [float(i // 2 % 3 == 0), float(i // 2 % 3 == 1), None]) for i in range(90)] + [("gx", None, [0.0, 0.0, 0.0])]
    got = grouped_classes(spark.createDataFrame(rows, "g string, y string, x array<double>"), "g", "y", "x").collect()
    assert len(got) == 90 and sum(r.y == r.prediction for r in got) == 90
    folds = {}
    for r in got:
        assert folds.setdefault(r.g, r.fold) == r.fold
    assert grouped_classes(spark.createDataFrame([], "g string, y string, x array<double>"), "g", "y", "x").count() == 0
