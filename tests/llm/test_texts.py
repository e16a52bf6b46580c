import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlight.llm.chunking import cut_oversized, cut_text
from cairnlight.llm.forms import LOOK_ALIKES, canonical_by_joins, canonical_texts, one_form, same_look_pairs
from cairnlight.llm.overlap import _blobs, _numbers, cosine_join, cross_split_overlaps, exact_runs, hashed_runs, overlap_report, vectors, words

NOTE = "PATIENT\n- one, two\n\nCOMPLAINT\nFirst sentence here. Second sentence is longer! Third?\n\n## Plan\n1. do this\n2. do that\n\n" + "X" * 90 + "\n\nEND\nlast words of the note"


@pytest.mark.parametrize("measure", ["characters", "tokens"])
@pytest.mark.parametrize("limit,overlap", [(40, 0), (40, 10), (25, 5), (7, 3), (1, 0), (3, 9), (1000, 50)])
@pytest.mark.parametrize("text", [NOTE, "é" * 60, "a\r\n" * 40, "", " ", "日本語のテキスト。" * 12, "é" * 30])
def test_pieces_fit_and_join(text, limit, overlap, measure):
    size = (lambda s: len(s)) if measure == "characters" else (lambda s: len(s.encode()))
    least = max([size(c) for c in text] or [1])
    pieces = cut_text(text, max(limit, least), overlap, measure)
    assert "".join(text[a + o : b] for a, b, o in pieces) == text
    for i, (a, b, o) in enumerate(pieces):
        assert size(text[a:b]) <= max(limit, least)
        if i and measure == "characters":
            assert o == min(overlap, max(limit, least) - 1, pieces[i - 1][1]) and a + o == pieces[i - 1][1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n#-é́:A"), max_size=200), st.integers(1, 30), st.integers(0, 12))
def test_pieces_property(text, limit, overlap):
    pieces = cut_text(text, limit, overlap)
    assert "".join(text[a + o : b] for a, b, o in pieces) == text
    assert all(b - a <= limit for a, b, _ in pieces)


def test_cuts_are_natural():
    ends = {NOTE[a + o : b].rstrip()[-1] for a, b, o in cut_text(NOTE, 60, 0) if b < len(NOTE)}
    assert all(b == len(NOTE) or NOTE[b - 1] in "\n " or NOTE[b - 1] == "X" for _, b, _ in cut_text(NOTE, 60, 0)), ends


def pieces_of(text, limit):
    return [text[a:b] for a, b, _ in cut_text(text, limit, 0)]


def test_sections_keep_to_themselves():
    text = "# A\naaa\n## A1\nbbb\n## A2\nddddd\n# B\nee\n"
    assert pieces_of(text, 20) == ["# A\naaa\n## A1\nbbb\n", "## A2\nddddd\n", "# B\nee\n"]


def test_siblings_are_merged_inside_their_parent():
    text = "# A\n## A1\nx\n## A2\ny\n## A3\nz\n# B\n## B1\nw\n"
    assert pieces_of(text, 24) == ["# A\n## A1\nx\n## A2\ny\n", "## A3\nz\n", "# B\n## B1\nw\n"]


def test_lists_are_cut_by_indentation():
    text = "- one\n  - in one\n  - in one too\n- two\n  - in two\n"
    assert pieces_of(text, 36) == ["- one\n  - in one\n  - in one too\n", "- two\n  - in two\n"]
    assert pieces_of(text, 20) == ["- one\n  - in one\n", "  - in one too\n", "- two\n  - in two\n"]


def test_markup_is_cut_by_nesting():
    text = "<div><p>aaaa</p><p>bbbb</p></div><div><p>cc</p></div>"
    assert pieces_of(text, 26) == ["<div><p>aaaa</p>", "<p>bbbb</p></div>", "<div><p>cc</p></div>"]
    assert "".join(pieces_of("<ul><li>a<li>b</ul></p><div>" * 5, 9)) == "<ul><li>a<li>b</ul></p><div>" * 5


def test_headings_go_with_what_follows():
    text = "PLAN\n" + "word " * 12 + "\n"
    assert pieces_of(text, 30)[0].startswith("PLAN\nword")
    deep = "".join("#" * (i % 6 + 1) + f" h{i}\ntext\n" for i in range(3000)) + "".join(" " * i + "- x\n" for i in range(400))
    assert "".join(pieces_of(deep, 50)) == deep


def test_oversized_table(spark):
    df = spark.createDataFrame([("a", NOTE, "clash"), ("b", None, ""), ("c", "short", ""), ("d", "w " * 50_000, "")], "id string, text string, piece string")
    limits = spark.createDataFrame([("t", "text", "characters", 60, 10), ("u", "text", "characters", None, 1)], "table_name string, field_name string, measure string, max_size int, overlap int")
    got = cut_oversized(df, "id", "text", limits, "t").collect()
    assert {r.id for r in got} == {"a", "d"} and max(r.n_size for r in got) <= 60
    for key, text in (("a", NOTE), ("d", "w " * 50_000)):
        own = sorted((r for r in got if r.id == key), key=lambda r: r.piece)
        assert "".join(r.text[r.overlap :] for r in own) == text and [r.piece for r in own] == list(range(1, len(own) + 1))
    assert cut_oversized(df, "id", "text", limits, "u").count() == 0 and cut_oversized(df.limit(0), "id", "text", limits, "t").count() == 0


# One form.

SAME = [("ﬁx", "fix"), ("Ａ１", "A1"), ("a b", "a b"), ("a​b", "ab"), ("é", "é"), ("а", "a"), ("Ο", "O"), ("x\r\ny\rz", "x\ny\nz"), ("q̣̇", "q̣̇"), ("й", "й"), ("‑", "-"), ("co­op", "coop"), ("가", "가")]
OTHER = [("e", "é"), ("1", "2"), ("x²", "x2"), ("a", "b"), ("a b", "ab"), ("A", "a"), ("ñ", "n"), ("и", "й"), ("", " ")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert one_form([a]) == one_form([b])


@pytest.mark.parametrize("a,b", OTHER)
def test_different_look(a, b):
    x, y = one_form([a, b])
    assert x != y


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cf", "Zs", "Zl", "Zp", "Cc", "Co", "Cn"], max_codepoint=0x24F) | st.sampled_from("̧̣́̈ae"), max_size=12), max_size=5))
def test_agrees_with_the_standard(texts):
    skip = {*LOOK_ALIKES, *(chr(c) for c in range(0x250) if "SMALL CAPITAL" in unicodedata.name(chr(c), ""))}
    texts = ["".join(c for c in t if not unicodedata.decomposition(c).startswith("<") and c not in skip) for t in texts]
    assert one_form(texts) == [unicodedata.normalize("NFC", t) for t in texts]
    assert one_form(one_form(texts)) == one_form(texts)


def test_pairs_and_table(spark):
    rows = [(1, "café"), (2, "café"), (3, "cafe"), (4, "café"), (5, None), (6, ""), (7, "​"), (8, "plain"), (9, "plain")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, look string")
    assert sorted(map(tuple, same_look_pairs(df).collect())) == [(1, 2), (1, 4), (6, 7)]
    got = {r.doc_id: (r.canonical, r.changed) for r in canonical_texts(df).collect()}
    assert got[2] == ("café", True) and got[5] == (None, None) and got[8] == ("plain", False)
    assert same_look_pairs(df.limit(0)).count() == 0


def test_form_by_joins(spark):
    """The form from numpy tables is that of the method on tables: exploded code points, broadcast joins, ordered marks."""
    rng = random.Random(7)
    pool = "abc XY1\t\n\r\x0b\x0c\x07éàñöẹ̣́̈̇̂ｗＡ\u00a0\u200b\u00ad\u2028аеоΑΟй𝐀ⅰꓮᴀ가각ﬁ…😀"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["", None, "plain", "\u0301", "\u0301\u0323a", "a" * 5000 + "e\u0301" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.canonical for r in canonical_by_joins(df).collect()}
    assert got == {i: one_form([t])[0] for i, t in enumerate(texts) if t is not None}
    assert canonical_by_joins(df.limit(0)).count() == 0


def test_many_copies_of_two_looks(spark):
    df = spark.createDataFrame([(i, "caf\u00e9" if i % 3 else "cafe\u0301") for i in range(90)], "doc_id bigint, text string")
    assert same_look_pairs(df).count() == 30 * 60


# Overlaps.


def make_texts(rng, n, words):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) for _ in range(n)]


def brute(queries, stored, least=40):
    out = set()
    for q, a in queries:
        x = exact_runs(a or "", 3)
        for s, b in stored:
            if len(words(a or "")) >= least and x and len(x & exact_runs(b or "", 3)) >= 0.5 * len(x):
                out.add((q, s))
    return out


@pytest.mark.parametrize("width", [3, 4])
def test_numbers_in_blobs(width):
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 8 * width, n)) for n in (1, 0, 300, 5)] + [np.array([0]), np.array([(1 << 8 * width) - 1]), np.zeros(0, dtype=np.int64)]
    values, counts = _numbers(_blobs(np.concatenate(sets), np.array([len(x) for x in sets]), width), width)
    assert counts.tolist() == [len(x) for x in sets] and values.tolist() == [v for x in sets for v in x]


def test_hashed_runs_count_distinct_runs():
    texts = ["a b c d a b c", "", "x", "a b", "A, b; C!", " ".join(["w"] * 9), "a b c d, A b c"]
    count, distinct, class_, owner, _ = hashed_runs(texts, 3)
    assert count.tolist() == [len(words(t)) for t in texts] and distinct.tolist() == [len(exact_runs(t, 3)) for t in texts]
    assert sorted(set(owner.tolist())) == [0, 4, 5, 6] and class_[0] == class_[6] and len(set(class_.tolist())) == 4


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(25)]
    stored = [(f"c{i}", t) for i, t in enumerate(make_texts(rng, 60, words))]
    queries = [(f"q{i}", t) for i, t in enumerate(make_texts(rng, 60, words))]
    for i in range(25):  # copies with edits around the border
        w = stored[i][1].split()
        for _ in range(i):
            w[rng.randrange(len(w))] = rng.choice(words)
        queries.append((f"e{i}", ("Noise, " * (i % 3)) + " ".join(w).upper()))
    queries += [("null", None), ("empty", ""), ("same", " ".join(["w1"] * 50)), ("q0x", queries[0][1])]
    stored += [("snull", None), ("ssame", "w1 w1 w1"), ("sempty", ""), (None, "x")]
    q = spark.createDataFrame([(a, b, "t", "s") for a, b in queries], "id string, text string, split string, source string")
    s = spark.createDataFrame([(a, b, "s", 1) for a, b in stored], "id string, text string, source string, shared int")
    want = brute(queries, [x for x in stored if x[0]])
    for bands, hits in ((None, 10**9), (1, 10**9), (4, 50), (40, 20)):
        found = cross_split_overlaps(q, s, bands=bands, task_hits=hits)
        rows = [(r.query_id, r.stored_id) for r in found.collect()]
        assert set(rows) == want and len(rows) == len(want)
    whole = {r.query_id: r.dot for r in found.collect() if r.shared == r.terms}
    assert whole and all(abs(x - 1) < 1e-6 for x in whole.values())
    report = overlap_report(q, s, found).collect()
    assert report[0].records == len(queries) and report[0].pairs == found.count()
    assert cross_split_overlaps(q.limit(0), s).count() == 0 and cross_split_overlaps(q, s.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("bands", [1, 4, 9])
def test_join_finds_all(spark, threshold, bands):
    rng = random.Random(4)
    known = [f"w{i}" for i in range(9)]
    texts = [(f"d{i}", t) for i, t in enumerate(make_texts(rng, 40, known))] + [("e", " ".join(["w1", "w2"] * 30)), ("f", "w1 w2"), ("g", "w1 w2")]
    v = vectors(spark.createDataFrame(texts, "id string, text string"), "id", "text", 2, 0)
    pairs, asked, _ = cosine_join(v, v, threshold, bands, 100)
    classes = {r[0]: r[1] for r in v.select("id", "class").collect()}
    got = {(r.query, r.stored) for r in pairs.collect()}
    sets = {k: exact_runs(t, 2) for k, t in texts}
    want = {(classes[a], classes[b]) for a in sets for b in sets if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a])}
    assert want <= got and {q for q, _ in want} <= {r[0] for r in asked.select("class").collect()}


def test_a_third_of_copies(spark):
    """A hot group of copies on both sides is joined once and its pairs of ids are all there."""
    rng = random.Random(5)
    known = [f"w{i}" for i in range(400)]
    texts = make_texts(rng, 60, known)
    hot = " ".join(known[:60])
    q = spark.createDataFrame([(f"q{i}", hot if i % 3 == 0 else t, "t", "s") for i, t in enumerate(texts)], "id string, text string, split string, source string")
    s = spark.createDataFrame([(f"s{i}", hot if i % 3 == 1 else t, "s") for i, t in enumerate(texts)], "id string, text string, source string")
    got = {(r.query_id, r.stored_id) for r in cross_split_overlaps(q, s).collect()}
    assert {(f"q{i}", f"s{j}") for i in range(0, 60, 3) for j in range(1, 60, 3)} <= got
    assert got == brute([(r.id, r.text) for r in q.collect()], [(r.id, r.text) for r in s.collect()])


def test_copies_and_hot_bands_dont_grow_the_shuffle(spark, monkeypatch):
    """Copies under other ids send no more than one text of each kind, and the lists of a band are sent to few parts however much there is to visit."""
    rng = random.Random(6)
    known = [f"w{i}" for i in range(60)]
    texts = make_texts(rng, 60, known)
    sent, split = [], type(spark.range(1)).repartitionById

    def counted(self, number, *columns):
        sent.append((number, sum(len(r.terms) for r in self.select("terms").collect())))
        return split(self, number, *columns)

    monkeypatch.setattr(type(spark.range(1)), "repartitionById", counted)
    found = []
    for copies in (1, 8):
        named = spark.createDataFrame([(f"{k}_{i}", t) for k in range(copies) for i, t in enumerate(texts)], "id string, text string")
        v = vectors(named, "id", "text", 3, 0)
        found.append({tuple(r) for r in cosine_join(v, v, 0.5, 4, 1)[0].collect()})
    assert found[0] == found[1]
    assert all(n <= 4 + 2 * spark.sparkContext.defaultParallelism for n, _ in sent)
    assert sent[1][1] <= 1.2 * sent[0][1]
