import json

import pytest

from cairnlight.llm.pairs import KINDS, Answer, copied_share, defective_pairs, feature_table, prompt_parts, refined_kinds, seeded_kinds, word_features

PROMPT = "Read the notes below. Give an assessment and a plan.\n\nSUBJECTIVE\nThe pain in the knee came on after a fall and gets worse at night. She has tried ice and rest for two weeks."
GOOD = "Assessment:\nMost likely a knee strain.\n1. knee strain\n2. gout\n3. bursitis\n\nPlan:\n- Rest the knee for {} weeks\n- Review in {} days by phone"


DOCS = {
    "en": ["the patient has pain in the knee and was told to rest", "review in two weeks with the diary and rest the shoulder", "most likely a strain of the knee without fever"],
    "de": ["die patientin hat schmerzen im knie und soll sich schonen", "kontrolle in zwei wochen mit dem tagebuch und ruhe", "am ehesten eine zerrung im knie ohne fieber"],
}


@pytest.mark.parametrize("raw", [None, "", " \n", "​", "N/A", "...", '""', "{}", "[]", '{"predictions": []}', "```json\n```", "{\"a\": null}", "Assessment:\nPlan:\n-", "## Assessment\n\n## Plan\n", '{"predictions": [{"condition": "", "plan": []}]}'])
def test_empty(raw):
    assert Answer(raw).says_nothing()


@pytest.mark.parametrize("raw", ["gout", "No answer", '{"predictions": [{"condition": "gout", "plan": []}]}', GOOD, "Plan:\n- rest"])
def test_not_empty(raw):
    assert not Answer(raw).says_nothing()


#: Phrasings that stand neither in the code nor in the test tables.
REFUSED = ("Regrettably this one has to go unanswered.", "Es ist mir nicht erlaubt, dazu etwas zu sagen.", "Sadly, commenting on someone's health is not something I am able to do.", "No puedo dar ninguna respuesta a esto.", "I'd prefer to leave this question to a professional.", "We are not allowed to answer such requests.")
ANSWERED = ("Contact a doctor if fever persists; take paracetamol 1 g.", "Most likely a strain of the knee, rest the shoulder and review in two weeks.", "Kontrolle in zwei Wochen mit dem Tagebuch und Ruhe.", "The patient declined an injection; rest the knee for 2 weeks.", "Gout")


def clinical_kinds():
    text = ["The patient has fever and cough; take paracetamol 1 g and contact the clinic if fever persists", "I cannot exclude gout; repeat the examination in 3 days", "Do not give aspirin, the patient declined it", "Ask a doctor about zinc"]
    return seeded_kinds(feature_table(word_features(text * 3 + [GOOD] * 20 + [t for ts in DOCS.values() for t in ts])))


@pytest.mark.parametrize("text,kind", [(t, "declined") for t in REFUSED] + [(t, "answer") for t in ANSWERED] + [("none", "nothing"), ("No answer.", "nothing"), ("not available", "nothing"), ("-", "nothing")])
def test_kinds_of_answers(text, kind):
    assert KINDS[int(clinical_kinds().posterior([text]).argmax())] == kind


def test_kinds_are_refined_by_the_table(spark):
    """A phrasing far from the sample is learnt from its many repetitions with other words around it."""
    strange = [f"Passing over {x} gladly, hands tied by policy." for x in ("this", "it", "such matters", "that case")]
    rows = [(False, "", ["Passing over requests, sorry, I cannot answer; hands tied by policy."])] * 3 + [(False, "", [x]) for x in strange] + [(True, "", ["rest the knee"])]
    found = spark.createDataFrame(rows, "listed boolean, verdict string, lines array<string>")
    kinds = refined_kinds(found, feature_table(word_features([GOOD] * 20)))
    assert all(KINDS[int(kinds.posterior([x]).argmax())] == "declined" for x in strange)


def test_copies_and_prompts():
    assert prompt_parts(json.dumps({"system": "s", "user": PROMPT}))[0] == "Read the notes below. Give an assessment and a plan."
    assert prompt_parts(None) == ("", "") and prompt_parts({"user": None})[0] == ""
    assert copied_share(PROMPT, ["THE PAIN in the knee, came on after a fall and gets worse at night"]) == 1.0
    assert copied_share(PROMPT, [GOOD]) < 0.2 and copied_share(PROMPT, []) == 0.0


def test_cut_json():
    whole = json.dumps({"predictions": [{"condition": "gout [acute", "plan": ["rest"]}]})
    assert not Answer(whole).cut and Answer(whole[:-1]).cut and Answer(whole[:30]).cut
    assert Answer("```json\n" + whole).cut and not Answer("```json\n" + whole + "\n```").cut




def slot(raw, status="completed", prompt=PROMPT):
    return {"assessment_plan_prompts": {"system": "x", "user": prompt}, "assessment_plans": {"m": {"status": status, "assessment_plan_raw": raw}}}


def test_table(spark):
    documents = spark.createDataFrame([(i * 10 + k, t, lang, "clash") for k, (lang, ts) in enumerate(DOCS.items()) for i, t in enumerate(ts * 5)] + [(900, None, "en", ""), (901, "x", None, "")], "doc_id bigint, text string, lang string, status string")
    german = "Beurteilung:\nAm ehesten eine Zerrung im Knie.\n1. Zerrung im Knie\n2. Ruhe\n\nVorgehen:\n- Das Knie zwei Wochen schonen\n- Kontrolle in zwei Wochen mit dem Tagebuch"
    answers = {"good": None, "empty": "null", "refusal": "I must decline this request.", "copied": "The pain in the knee came on after a fall and gets worse at night.", "language": german, "truncated": GOOD.format(3, 4)[:-6]}
    rows = []
    for i in range(40):
        rows.append((i, "completed", None, None, json.dumps({"v": slot(GOOD.format(i + 2, i + 3))})))
    for i, (name, raw) in enumerate(answers.items()):
        rows.append((100 + i, "completed", None, None, json.dumps({name: slot(raw or GOOD.format(5, 5))})))
        rows.append((200 + i, "completed", None, None, json.dumps({name: slot(raw, "failed")})))
    rows += [(300, "completed", json.dumps({"user": PROMPT}), " ", None), (301, "failed", None, None, None), (302, "completed", None, None, "not json"), (303, "completed", None, None, "[1]"), (304, "completed", None, GOOD.format(7, 7), None)]
    results = spark.createDataFrame(rows, "result_id bigint, status string, assessment_plan_prompts string, assessment_plan_raw string, variants string")
    got = {(r.result_id, r.variant, r.model): r.defect for r in defective_pairs(results, documents).collect()}
    want = {(100 + i, name, "m"): name for i, name in enumerate(answers) if name != "good"} | {(300, "", ""): "empty"}
    assert got == want
    assert defective_pairs(results.limit(0), documents).count() == 0
    assert {r.defect for r in defective_pairs(results, documents.limit(0)).collect()} == {"empty", "refusal", "copied", "truncated"}
