import random
from collections import Counter

import pytest

from cairnlight.llm.mixing import filled_budgets, Mixture, bisect_exponent, entropy, tempered
from cairnlight.llm.packing import container_report, length_class, pack, plan_containers


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_item_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 512): rng.choice([1, 2, 5, 40, 3000]) for _ in range(rng.randint(0, 60))}
    got = Counter()
    for need, times in plan_containers(histogram, 512):
        assert times > 0 and sum(c * k for c, k in need.items()) <= 512
        for c, k in need.items():
            got[c] += k * times
    assert got == Counter(histogram)


def test_plan_is_tight():
    rng = random.Random(9)
    histogram = Counter(min(512, int(rng.lognormvariate(4.2, 0.9)) + 1) for _ in range(20000))
    used = sum(c * n for c, n in histogram.items())
    assert used / 512 / sum(t for _, t in plan_containers(dict(histogram), 512)) > 0.985


def test_small_items_waste_no_room():
    assert sum(t for _, t in plan_containers({1: 100_000}, 8192)) == 13
    rng = random.Random(2)
    items = [rng.randint(1, 200) for _ in range(50_000)]
    plan = plan_containers(Counter(length_class(x, 8192) for x in items), 8192)
    assert sum(items) / 8192 / sum(t for _, t in plan) > 0.985


@pytest.mark.parametrize("capacity", [1, 7, 100, 512, 513, 8192, 100_003])
def test_length_classes(capacity):
    for x in {1, 2, 63, 64, 127, 128, 129, 255, 256, 257, 300, 511, 4095, capacity - 1, capacity, capacity // 2} & set(range(1, capacity + 1)):
        c = length_class(x, capacity)
        assert x <= c <= capacity and c - x <= max(-(-capacity // 512), x // 64)
    assert len({length_class(x, capacity) for x in range(1, capacity + 1)}) < 2000


def sizes(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, size bigint, container string")


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 50, 700, 4000, 8191, 8192])) for i in range(400)] + [(1000, 8193), (1001, 30000), (1002, None), (1003, 0), (1004, 16384), (5, 77)]
    got = pack(sizes(spark, rows), "doc_id", "size", 8192).collect()
    full = Counter()
    for r in got:
        if r.container is not None:
            full[r.container] += r.length
    assert max(full.values()) <= 8192
    assert sorted(x for r in got for x in [r.length] if r.container is not None) == sorted(p for _, s in rows if s for p in [8192] * (s // 8192) + [s % 8192] * (s % 8192 > 0))
    assert {r.id for r in got if r.piece > 1} == {1000, 1001, 1004}
    assert sorted(r.id for r in got if r.container is None) == [1002, 1003]
    for key in (1001,):
        own = sorted((r.start, r.length) for r in got if r.id == key)
        assert own == [(0, 8192), (8192, 8192), (16384, 8192), (24576, 5424)]


def test_pack_one_hot_size_and_nothing(spark):
    got = pack(sizes(spark, [(i, 2000) for i in range(1000)]), "doc_id", "size", 8192)
    report = container_report(got, 8192).first()
    assert report.containers == 250 and report.used == 2_000_000
    empty = pack(sizes(spark, []), "doc_id", "size", 8192)
    assert empty.count() == 0 and container_report(empty, 8192).first().containers == 0


def test_temperature():
    shares, even = {"a": 0.9, "b": 0.1}, {"a": 0.5, "b": 0.5}
    assert tempered(shares, even, 0) == pytest.approx(shares) and tempered(shares, even, 1) == pytest.approx(even)
    e = bisect_exponent(shares, even, target_entropy=0.5)
    assert entropy(tempered(shares, even, e)) == pytest.approx(0.5, abs=1e-9)
    e = bisect_exponent(shares, even, max_repeats={"a": 1, "b": 2})
    assert tempered(shares, even, e)["b"] == pytest.approx(0.2, abs=1e-6)
    assert bisect_exponent(shares, even, max_repeats={"a": 1, "b": 9}) == 1.0


def mixture(spark, docs, targets):
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, source string, size bigint, pass int")
    return Mixture(d, spark.createDataFrame(targets, "source string, weight_pct int, max_repeats int"))


def test_mixture(spark):
    docs = [(i, "big", 10) for i in range(700)] + [(1000 + i, "small", 10) for i in range(100)] + [(2000 + i, None, 10) for i in range(200)] + [(3000, "big", None)]
    m = mixture(spark, docs, [("big", 30, 1), ("small", 60, 3), ("none", 10, 5), (None, 0, 1)])
    got = m.records().collect()
    uses = Counter((r.id, r.source) for r in got)
    assert max(n for (_, s), n in uses.items() if s == "big") == 1 and set(n for (_, s), n in uses.items() if s == "small") == {3}
    report = {r.source: r for r in m.report().collect()}
    # What small and none lack of the 10,000 goes to big.
    assert report["big"].goal == 3000 and report["big"].reached == 7000 and report["big"].in_reach and report["small"].reached == 3000 and not report["small"].in_reach
    assert report["none"].reached == 0 and not report["none"].in_reach
    assert report["big"].share_of_total == 0.7 and report["small"].share_of_mixture == 0.3


def test_mixture_fills_its_parts(spark):
    """Every source that isn't exhausted ends within one document of its part, past documents that don't fit."""
    rng = random.Random(3)
    docs = [(i, rng.choice("aab") if i % 9 else "c", rng.choice([7, 80, 900, 5000])) for i in range(900)]
    m = mixture(spark, docs, [("a", 30, 2), ("b", 50, 3), ("c", 15, 2), ("d", 5, 9)])
    got = m.records().collect()
    report = {r.source: r for r in m.report().collect()}
    total = sum(s for *_, s in docs)
    assert total - 3 <= sum(r.part for r in report.values()) <= total
    for s, r in report.items():
        used = {x.id for x in got if x.source == s and x["pass"] == r.repeats}
        unused = [n for i, o, n in docs if o == s and i not in used]
        assert r.reached == sum(x.size for x in got if x.source == s) <= r.part
        assert r.reached == r.size * r.max_repeats or r.part - r.reached < min(unused, default=1)
    assert max(Counter(x.id for x in got).values()) <= 3 and len({(x.id, x["pass"]) for x in got}) == len(got)
    soft = {r.source: r for r in Mixture(m.items, m._plan(), "id", weights="tempered").report().collect()}
    assert all(abs(r.share_of_total - r.tempered_share) < 0.01 for r in soft.values())


def test_blocks_have_all_sources_in_their_share(spark):
    docs = [(i, "ab"[i % 2], 10) for i in range(2000)]
    got = mixture(spark, docs, [("a", 75, 2), ("b", 25, 1)]).sequence(block_size=2000).collect()
    blocks = {}
    for r in got:
        blocks.setdefault(r.block, Counter())[r.source] += r.size
    assert len(blocks) == 10 and all(abs(c["a"] - 1500) <= 10 and abs(c["b"] - 500) <= 10 for c in blocks.values())
    assert len({(r.id, r["pass"]) for r in got}) == len(got)


def test_large_sizes(spark):
    m = mixture(spark, [(i, "ab"[i % 2], 10**12) for i in range(4)], [("a", 90, 1), ("b", 10, 1)])
    assert {r.source: r.in_reach for r in m.report().collect()} == {"a": False, "b": True}


def test_budgets_under_caps():
    assert filled_budgets({"a": 100, "b": 10, "c": 1000}, {"a": 50, "b": 30, "c": 20}, 200) == {"a": 100, "b": 10, "c": 90}
    assert filled_budgets({"a": 5, "b": 5}, {"a": 1, "b": 0}, 200) == {"a": 5, "b": 0} and filled_budgets({}, {}, 5) == {}


def test_mixture_of_nothing(spark):
    m = mixture(spark, [], [("a", 100, 2)])
    assert m.records().count() == 0 and m.report().first().reached == 0 and m.sequence().count() == 0
    assert mixture(spark, [(1, "a", 5)], []).report().count() == 0
