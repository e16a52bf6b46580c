import json

import pytest
from pyspark.sql import functions as F

from cairnlight.functions import parsing as P
from cairnlight.operators import context as X
from cairnlight.operators import knowledge as K
from cairnlight.operators.retrieval import dense_top_k_many
from cairnlight.plans.context import read_codes


@pytest.mark.parametrize("text", ['{"a": 1, "a": 2}', '{"a": NaN}', "[1]", '{"a": 1e999}', "", "x", '{"a": Infinity}', None])
def test_strict_rejects(text):
    assert P.strict_object(text) is None


@pytest.mark.parametrize(
    "text,value",
    [
        ('Sure: {"a": [1, 2,], }', {"a": [1, 2]}),
        ('```json\n{"a": "x"}\n``` done', {"a": "x"}),
        ('{"a": {"b": [1, 2', {"a": {"b": [1, 2]}}),
        ('{"a": "cut of', {"a": "cut of"}),
        ('{"a": 1, "b":', {"a": 1}),
        ('{"a": 1} trailing }', {"a": 1}),
    ],
)
def test_repair(text, value):
    assert json.loads(P.repaired_object(text)) == value


def test_repair_gives_up():
    assert P.repaired_object("no braces") is None and P.repaired_object(None) is None


def test_tuples(spark):
    text = '("entity"<|>gout<|>condition<|>painful toe)##("entity"<|>GOUT<|>condition<|>urate)##("relationship"<|>gout<|>urate<|>rises<|>2.5)##("relationship"<|>gout<|>urate<|>rises<|>strong)##broken<|COMPLETE|>'
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "unit int, text string")
    assert [tuple(r) for r in P.extracted_entities(df, "unit", "text").collect()] == [(1, "GOUT", "CONDITION", "painful toe\nurate")]
    assert [tuple(r) for r in P.extracted_relationships(df, "unit", "text").collect()] == [(1, "GOUT", "URATE", "rises", 3.5)]
    claim = spark.createDataFrame([(1, "(A<|>B<|>T<|>TRUE<|>2024<|>2025<|>d<|>s)##(C<|>NONE)")], "unit int, text string")
    got = [tuple(r) for r in P.extracted_claims(claim, "unit", "text").orderBy("subject_id").collect()]
    assert got == [(1, "A", "B", "T", "TRUE", "2024", "2025", "d", "s"), (1, "C", "NONE", None, None, None, None, None, None)]


def test_phrases():
    assert P.noun_phrases("The Iron Deficiency, a follow-up; X") == ["THE IRON", "DEFICIENCY", "FOLLOW-UP"] or "FOLLOW-UP" in P.noun_phrases("a follow-up")
    grammar = {("JJ", "NN"): "NN", ("NN", "NN"): "NN"}
    assert P.merge_phrases([("acute", "JJ"), ("ear", "NN"), ("pain", "NN"), ("is", "VB")], grammar) == [("acute ear pain", "NN"), ("is", "VB")]


def test_drift(spark):
    start = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "action string, score double")
    follow = lambda chosen, n: chosen.select(F.concat("action", F.lit(str(n))).alias("action"), F.lit(2.0).alias("score"))
    got = {r.action: (r.answered, r.depth) for r in X.drift_search(start, follow, 2, 1).collect()}
    assert got == {"a": (False, 0), "b": (False, 0), "c": (True, 0), "c1": (True, 1), "c12": (False, 2)}


def test_gates(spark):
    e = spark.createDataFrame([("s", "a"), ("a", "t"), ("s", "b"), ("b", "x"), ("z", "a")], "source string, target string")
    gates = spark.createDataFrame([("a", "hidden"), ("a", "visible"), ("t", "skip"), ("b", "visible")], "node string, gate string")
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    got = {r["node"]: r["class"] for r in X.gate_classes(e, gates, one("t"), one("s")).collect()}
    assert got == {"s": None, "a": "visible", "t": "skip"}
    blocked = K.reachable(e, one("s"), one("a"))
    assert {r.node for r in blocked.collect()} == {"s", "b", "x"}


def test_dynamic_selection_falls_through(spark):
    tree = spark.createDataFrame([(0, -1, 0, 0), (1, -1, 0, 0), (2, 0, 1, 5), (3, 1, 1, 0), (4, 2, 2, 9)], "community int, parent int, level int, rating int")
    assert [r.community for r in X.selected_communities(tree, "rating", 3).collect()] == [4]


def test_budgets_must_fit(spark):
    with pytest.raises(ValueError):
        X.local_context(*[spark.range(1)] * 5, 10, 0.6, 0.5)


def test_codes():
    assert read_codes("# x\n12 # y\n3\n12\n") == ["12", "3"]
    with pytest.raises(ValueError):
        read_codes("12a")


def test_modules():
    tree = {"condition_type": "And", "conditions": [{"condition_type": "Age"}, {"condition_type": "Not", "condition": {"condition_type": "Or", "conditions": [{"condition_type": "Sex"}, {"condition_type": "Race"}]}}]}
    assert K.modules_of(tree) == ["Age", "Sex", "Race"]


def test_top_k_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(9)] + [(20, [0.0, 1.0]), (21, None), (22, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = [(r.query_id, r.vec_id, r["rank"]) for r in dense_top_k_many(df, df.filter("vec_id in (0, 21, 22)"), 3, slices=2).orderBy("rank").collect()]
    assert got == [(0, 0, 1), (0, 1, 2), (0, 2, 3)]
    assert dense_top_k_many(df.limit(0), df, 3, slices=2).count() == 0


def test_entity_and_relationship_merges(spark):
    e = "id string, title string, type string, description array<string>, text_unit_ids array<string>"
    old = spark.createDataFrame([("o1", "A", "x", ["d"], ["1", "2"])], e)
    new = spark.createDataFrame([("n1", "A", "y", ["e"], ["2"]), ("n2", "B", "y", [], [])], e)
    got = {r.title: (r.id, r.type, r.description, r.frequency) for r in K.merge_entities(old, new).collect()}
    assert got == {"A": ("o1", "x", ["d", "e"], 3), "B": ("n2", "y", [], 0)}
    r = "id string, source string, target string, weight double"
    merged = K.merge_relationships(spark.createDataFrame([("r1", "A", "B", 2.0)], r), spark.createDataFrame([("r2", "A", "B", 4.0), ("r3", "A", "C", 1.0)], r))
    assert sorted((x.id, x.weight, x.combined_degree) for x in merged.collect()) == [("r1", 3.0, 3), ("r3", 1.0, 3)]
