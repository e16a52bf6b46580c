import random

from cairnlight.operators import knowledge as K
from cairnlight.operators.communities import community_table, hierarchical_leiden, leiden


def clique(names):
    return [(a, b, 1.0) for i, a in enumerate(names) for b in names[i + 1 :]]


def graph(spark, links):
    return spark.createDataFrame(links, "source string, target string, weight double")


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.community, set()).add(r.node)
    return sorted(map(sorted, out.values()))


def test_cliques_are_communities(spark):
    names = [[f"{x}{i}" for i in range(5)] for x in "abcd"]
    links = [e for n in names for e in clique(n)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0), ("c2", "d2", 1.0), ("d3", "a3", 1.0)] + [("z", "z", 1.0), (None, "a0", 1.0)]
    got = hierarchical_leiden(graph(spark, links)).collect()
    assert groups([r for r in got if r.level == 0]) == sorted([*names, ["z"]]) and all(r.parent is None for r in got)


def test_large_communities_are_divided(spark):
    rng = random.Random(1)
    blocks = [[f"{x}{y}{i}" for i in range(4)] for x in "ab" for y in "pqr"]
    links = [e for b in blocks for e in clique(b)]
    for x in "ab":
        inner = [n for b in blocks for n in b if n[0] == x]
        links += [(*sorted(rng.sample(inner, 2)), 1.0) for _ in range(8)]
    links += [("ap0", "bp0", 0.5)]
    e = graph(spark, links)
    rows = hierarchical_leiden(e, max_size=6).collect()
    top = {r.node: r.community for r in rows if r.level == 0}
    assert len(top) == 24
    for r in rows:
        if r.level:
            assert r.parent in {x.community for x in rows if x.level == r.level - 1 and x.node == r.node}
    member = spark.createDataFrame([(r.node, r.community) for r in rows if r.level == 0], "node string, community string")
    assert K.modularity(e, member).first()[0] > 0.4
    full = spark.createDataFrame(rows, "node string, level int, community string, parent string")
    table = {r.community: r for r in community_table(full, e, "2026-01-01").collect()}
    assert sum(r.size for r in table.values() if r.level == 0) == 24
    for r in table.values():
        assert all(table[c].parent == r.community for c in r.children) and (not r.children or sum(table[c].size for c in r.children) == r.size)


def test_karate_club(spark):
    text = "1-2 1-3 2-3 1-4 2-4 3-4 1-5 1-6 1-7 5-7 6-7 1-8 2-8 3-8 4-8 1-9 3-9 3-10 1-11 5-11 6-11 1-12 1-13 4-13 1-14 2-14 3-14 4-14 6-17 7-17 1-18 2-18 1-20 2-20 1-22 2-22 24-26 25-26 3-28 24-28 25-28 3-29 24-30 27-30 2-31 9-31 1-32 25-32 26-32 29-32 3-33 9-33 15-33 16-33 19-33 21-33 23-33 24-33 30-33 31-33 32-33 9-34 10-34 14-34 15-34 16-34 19-34 20-34 21-34 23-34 24-34 27-34 28-34 29-34 30-34 31-34 32-34 33-34"
    e = graph(spark, [(*x.split("-"), 1.0) for x in text.split()])
    found = leiden(e.selectExpr("'' as home", "source", "target", "weight"))
    q = K.modularity(e, found.select("node", "community")).first()[0]
    assert q > 0.38  # the best known is 0.4198


def test_no_graph(spark):
    assert hierarchical_leiden(graph(spark, [])).count() == 0
