import json

import pytest

from cairnlight.operators.shredding import ResultTables, shred, shred_value

RESULTS = "result_id bigint, predictions string, evaluation string, variants string, run_name string, model string"


def rows(spark, *values):
    return spark.createDataFrame([(*v, "r", "clash") for v in values], RESULTS)


def items(df):
    return sorted((r.record, r.variant, r.model, r.rank, r.step, r.text) for r in ResultTables(df, scores=False).plan_items().collect())


def test_adjacency_gives_back_the_document():
    value = {"a": [1, {"b": None}, "x"], "c": {"d": True, "e": []}}
    nodes = shred_value(value, frozenset(), frozenset())

    def build(n):
        kids = [x for x in nodes if x[1] == n[0]]
        if n[5] == "object":
            return {k[3]: build(k) for k in kids}
        if n[5] == "array":
            return [build(k) for k in sorted(kids, key=lambda k: k[4])]
        return None if n[5] == "null" else n[6] if n[5] == "string" else json.loads(n[6])

    assert build(nodes[0]) == value
    assert [n[0] for n in nodes] == list(range(len(nodes)))


def test_shapes_of_predictions(spark):
    listed = [{"condition": "a", "plan": ["p", None, {"text": "q", "kind": "k"}]}, {"condition": "b", "plan": "only"}, {"condition": "c"}, {"condition": None, "plan": None}]
    keyed = {"2": {"condition": "z", "plan": ["two"]}, "1": {"condition": "y", "plan": ["one", "", {"kind": "no text"}]}}
    nested = {"v": {"assessment_plans": {"m": {"status": "failed", "predictions": json.dumps(listed)}, "n": {"status": "completed", "predictions": keyed}, "o": {"predictions": None}}}}
    df = rows(spark, (1, json.dumps(listed), None, None), (2, None, None, json.dumps(nested)), (3, None, None, json.dumps(json.dumps(nested))), (4, "not json", "", " "), (5, None, None, None))
    one = [(1, 1, "p"), (1, 3, "q"), (2, 1, "only")]
    two = [(1, 1, "one"), (1, 2, ""), (2, 1, "two")]
    wanted = [(1, "", "", *x) for x in one]
    for record in (2, 3):
        wanted += [(record, "v", "m", *x) for x in one] + [(record, "v", "n", *x) for x in two]
    assert items(df) == sorted(wanted)


def test_scores_and_links(spark):
    evaluation = [{"rank": 2, "condition": {"metrics": {"judge": {"status": "scored", "value": 1.5}}}}, {"rank": 1, "plan": {"metrics": {"overlap": {"status": "no_label", "value": None}}}}]
    t = ResultTables(rows(spark, (7, None, json.dumps(evaluation), None)))
    got = sorted((r.rank, r.part, r.metric, r.status, r.value) for r in t.scores().collect())
    assert got == [(1, "plan", "overlap", "no_label", None), (2, "condition", "judge", "scored", 1.5)]
    outputs = {(r.record, r.root, r.node) for r in t.outputs().collect()}
    assert {(r.record, r.root, r.slot_node) for r in t.scores().collect()} <= outputs


def test_every_row_links_to_its_parent(spark):
    nested = {"v": {"assessment_plans": {"m": {"predictions": [{"condition": "a", "plan": ["p"]}]}}}}
    t = ResultTables(rows(spark, (1, None, None, json.dumps(nested))))
    variant, output, prediction, item = (x.first() for x in (t.variants(), t.outputs(), t.predictions(), t.plan_items()))
    assert output.variant_node == variant.node
    assert prediction.slot_node == output.node
    assert item.prediction_node == prediction.node


def test_empty_and_null(spark):
    assert ResultTables(rows(spark)).plan_items().count() == 0
    assert ResultTables(rows(spark, (None, None, None, None))).predictions().count() == 0
    assert shred(rows(spark, (1, "", None, "")), "result_id", ["predictions", "variants"]).count() == 0


@pytest.mark.parametrize("text", ["{", "nul", "[" * 5000])
def test_unreadable_texts_give_no_rows(spark, text):
    assert shred(rows(spark, (1, text, None, None)), "result_id", ["predictions"]).count() == 0


def test_nothing_of_a_slot_is_left_out(spark):
    """Prompts, raw answers, model calls and components come out, and a variant, model or metric may be named like one of them."""
    call = {"reported_model": "x", "response_id": "r", "token_usage": {"total_tokens": 7}}
    made = {"guide": {"component": "g", "status": "on", "settings": {"top_k": 3}, "capture": {"retrieval_keywords": ["a", None, "b"]}}}
    slot = {"predictions": [{"condition": "a", "plan": ["p"]}], "assessment_plan_raw": "{\"said\": 1}", "model_responses": [call], "evaluation": [{"condition": {"metrics": {"components": {"value": 2}}}}]}
    nested = {"components": {"components": made, "assessment_plan_prompts": {"system": None, "user": "u"}, "assessment_plans": {"evaluation": slot, "model_responses": slot}}}
    given = [
        (1, json.dumps(nested), None, None, json.dumps(made), None, None, None),
        (2, None, None, None, None, json.dumps({"system": "s", "user": "w"}), "raw", json.dumps({"first": [call, call]})),
    ]
    df = spark.createDataFrame(given, "result_id bigint, variants string, predictions string, evaluation string, components string, assessment_plan_prompts string, assessment_plan_raw string, model_responses string")
    t = ResultTables(df)
    slots = [(1, "components", "evaluation"), (1, "components", "model_responses")]
    assert items(df) == [(*s, 1, 1, "p") for s in slots]
    assert sorted((r.record, r.variant, r.model, r.metric, r.value) for r in t.scores().collect()) == [(*s, "components", 2.0) for s in slots]
    outputs = {(r.record, r.root, r.node) for r in t.outputs().collect()}
    answers, calls = t.answers().collect(), t.responses().collect()
    assert sorted((r.record, r.variant, r.model, r.raw) for r in answers) == [(*s, "{\"said\": 1}") for s in slots] + [(2, "", "", "raw")]
    assert sorted((r.record, r.variant, r.model, r.step, r.ordinal, r.response_id, r.total_tokens) for r in calls) == [(*s, "", 0, "r", 7) for s in slots] + [(2, "", "", "first", i, "r", 7) for i in (0, 1)]
    assert {(r.record, r.root, r.slot_node) for r in answers + calls} == outputs
    assert sorted((r.record, r.variant, r.system, r.user) for r in t.prompts().collect()) == [(1, "components", None, "u"), (2, "", "s", "w")]
    components = t.components().collect()
    assert sorted((r.variant, r.owner_node is None, r.name, r.component, r.status, r.top_k) for r in components) == [("", True, "guide", "g", "on", 3), ("components", False, "guide", "g", "on", 3)]
    words = t.keywords().collect()
    assert sorted((r.variant, r.ordinal, r.keyword) for r in words) == [(v, *x) for v in ("", "components") for x in ((0, "a"), (2, "b"))]
    assert {(r.root, r.component_node) for r in words} == {(r.root, r.node) for r in components}


def test_half_a_surrogate_pair_stops_nothing(spark):
    text = '{"a": "x\\ud83d", "b": 1.5, "c": true, "d": null}'
    got = {r.label: r.scalar for r in shred(rows(spark, (1, text, None, None)), "result_id", ["predictions"]).filter("depth = 1").collect()}
    assert got == {"a": "x?", "b": "1.5", "c": "true", "d": None}
