"""Queries cover all rows of their tables."""

import datetime
import inspect
import json
from collections import defaultdict

from cairnlight.operators.probes import grouped_probe, hashed_counts, probe_counts
from cairnlight.operators.shredding import ResultTables
from cairnlight.plans import queries as core


def test_context_levels_takes_all_documents(spark, tmp_path):
    """Documents with ids of 200 and more count; the query's own SQL still leaves them out."""
    sources = ("progress_note", "letter", "report", None)
    rows = [(i, sources[i % 4], 40 + i * (8 if i % 4 == 2 else 1)) for i in range(600)]
    spark.createDataFrame(rows, "doc_id bigint, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    held = defaultdict(list)
    for i, source, n in rows:
        if source is not None:
            held[source].append((-n, i, n // 4))
    wanted = {}
    for source, items in held.items():
        total = sum(c for _, _, c in items)
        if total <= 9000:
            wanted[source] = ("valid", total)
        elif source == "progress_note":
            wanted[source] = ("substituted", 700)
        else:
            run = 0
            for _, _, cost in sorted(items):
                if run + cost > 9000:
                    break
                run += cost
            wanted[source] = ("trimmed", run)
    got = {r.community: (r.kind, r.cost) for r in core.queries()["context_levels"](spark, str(tmp_path)).collect()}
    assert got == wanted
    assert got["progress_note"][0] == "substituted"  # "valid" on the first 200 documents


STATED = "result_id bigint, status string, predictions string, evaluation string, variants string"


def test_outputs_one_slot_for_each_row_without_variants(spark):
    listed = json.dumps([{"condition": "a", "plan": ["p", "q"]}])
    judged = json.dumps([{"rank": 1, "condition": {"metrics": {"judge": {"status": "scored", "value": 1}}}}])
    nested = json.dumps({"v": {"status": "completed", "assessment_plans": {
        "m": {"status": "failed", "error": {"type": "T", "message": "said"}, "predictions": None}, "n": {"status": "completed", "error": None, "predictions": json.loads(listed)}}}})
    given = [(1, "completed", None, None, None), (2, "completed", listed, judged, None), (3, "failed", None, judged, " "), (4, "completed", listed, None, None), (5, "completed", None, None, nested)]
    t = ResultTables(spark.createDataFrame(given, STATED))
    outputs = t.outputs().collect()
    assert sorted((r.record, r.variant, r.model, r.status, r.error_type, r.error_message) for r in outputs) == [
        (1, "", "", "completed", None, None), (2, "", "", "completed", None, None), (3, "", "", "failed", None, None), (4, "", "", "completed", None, None),
        (5, "v", "m", "failed", "T", "said"), (5, "v", "n", "completed", None, None),
    ]
    slots = {(r.record, r.root, r.node) for r in outputs}
    predictions, scores = t.predictions().collect(), t.scores().collect()
    assert sorted(r.record for r in predictions) == [2, 4, 5] and sorted(r.record for r in scores) == [2, 3]
    assert {(r.record, r.root, r.slot_node) for r in predictions + scores} <= slots
    assert len({(r.root, r.slot_node) for r in predictions + scores if r.record == 2}) == 1
    assert sorted((r.record, r.step, r.text) for r in t.plan_items().collect()) == [(k, *x) for k in (2, 4, 5) for x in ((1, "p"), (2, "q"))]


def test_probe_counts_have_no_cap(spark):
    observed = spark.createDataFrame([("p", "Hot a", "2020-01-01")] * 50 + [("p", "b", "2020-01-01"), ("q", "b", "2020-01-01")], "patient string, description string, date string")
    met = spark.createDataFrame([("q", "c", "2020-01-01")], "patient string, description string, start string")
    cutoffs = spark.createDataFrame([("p", datetime.date(2021, 1, 1))], "patient string, cutoff date")
    counts = probe_counts(met, observed, cutoffs).withColumn("v", hashed_counts("terms", 1 << 12))
    got = {r.patient: (r.label, [tuple(x) for x in r.terms], sorted(tuple(x) for x in r.pairs), sorted(r.v.values)) for r in counts.collect()}
    assert got == {"p": (1.0, [("b", 1), ("hot_a", 50)], [("b hot_a", 1), ("hot_a hot_a", 49)], [1, 50]), "q": (0.0, [("b", 1), ("c", 1)], [("b c", 1)], [1, 1])}
    assert inspect.signature(grouped_probe).parameters["folds"].default == 5


def test_single_judges_scores(spark):
    judge = {"status": "scored", "value": 3, "runs": [{"judge": "j1", "score": 1}, {"judge": "j2", "score": 2}]}
    entries = [{"rank": 1, "condition": {"metrics": {"judge": judge}}}]
    nested = {"v": {"assessment_plans": {"m": {"status": "completed", "evaluation": entries}}}}
    t = ResultTables(spark.createDataFrame([(1, "completed", None, json.dumps(entries), None), (2, "completed", None, None, json.dumps(nested))], STATED))
    single, scores = t.judge_scores().collect(), {(r.record, r.root, r.node): r.value for r in t.scores().collect()}
    assert sorted((r.record, r.variant, r.model, r.rank, r.part, r.metric, r.ordinal, r.judge, r.score) for r in single) == [
        (k, *slot, 1, "condition", "judge", i, f"j{i + 1}", i + 1.0) for k, slot in ((1, ("", "")), (2, ("v", "m"))) for i in range(2)
    ]
    assert {scores[r.record, r.root, r.score_node] for r in single} == {3.0} and len(scores) == 2
