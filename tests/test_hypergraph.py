import math

import pytest

from polyad.errors import BadInput
from polyad.functions.stats import hypergeometric_tail, p_adjust
from polyad.operators import communities as C
from polyad.operators import hypergraph as H
from polyad.operators import spectral as P
from polyad.operators import structure as S
from polyad.operators.sequences import from_wide  # noqa: F401


def hg(spark, **edges):
    rows = [(n, e, 1.0) for e, ns in edges.items() for n in ns]
    return spark.createDataFrame(rows, "node string, edge string, weight double")


@pytest.fixture(scope="module")
def four(spark):
    return hg(spark, e1="abc", e2="cd", e3="ad", e4="abcd")


def pairs(df):
    return {(r["node_a"] + r["node_b"]): r["weight"] for r in df.collect()}


def test_window_sets(spark):
    s = spark.createDataFrame([("1", i + 1, x) for i, x in enumerate("abac")], "seq_id string, pos int, state string")
    m, e = H.windows(s, 2)
    assert {r["edge"]: r["edge_weight"] for r in e.collect()} == {"a | b": 2.0, "a | c": 1.0}
    assert {(r["edge"], r["node"]): r["weight"] for r in m.collect()} == {("a | b", "a"): 2, ("a | b", "b"): 2, ("a | c", "a"): 1, ("a | c", "c"): 1}


def test_groups_drop_nulls_and_duplicates(spark):
    df = spark.createDataFrame([("Dave", "S3"), ("Carol", "S3"), ("Dave", "S3"), (None, "S3"), ("x", None)], "a string, g string")
    assert H.groups(df, "a", "g").count() == 2
    assert H.delimited(spark.createDataFrame([("a; b;;a", "g")], "m string, g string"), "m", "g").count() == 2


def test_projections(four):
    a = pairs(S.association_projection(four))
    assert math.isclose(a["ab"], 5 / 6) and math.isclose(a["ad"], 4 / 3) and math.isclose(a["bd"], 1 / 3)
    c = pairs(S.clique_projection(four))
    assert c["bd"] == 1 and set(c.values()) == {1.0, 2.0}
    o = {r["edge_a"] + r["edge_b"]: r["overlap"] for r in S.edge_overlaps(four).collect()}
    assert o == {"e1e2": 1, "e1e3": 1, "e1e4": 3, "e2e3": 1, "e2e4": 2, "e3e4": 2}


def test_transitivity(spark):
    m = hg(spark, e1="abc", e2="ad", e3="bd")
    assert {r["node"]: round(r["transitivity"], 6) for r in S.projection_transitivity(m).collect()}["a"] == round(2 / 3, 6)
    get = lambda k: {r["node"]: r["transitivity"] for r in S.pair_transitivity(m, k).collect()}["a"]
    assert math.isclose(get("union"), (1 / 3 + 1 / 2 + 1 / 3) / 3) and math.isclose(get("min"), (1 / 2 + 1 + 1 / 2) / 3) and math.isclose(get("max"), 1 / 2)
    with pytest.raises(BadInput):
        S.pair_transitivity(m, "x")


def test_modularity(spark):
    m = hg(spark, e1="ab", e2="cd")
    lab = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "node string, label int")
    for kind in ("linear", "majority", "strict"):
        assert math.isclose(C.modularity(m, lab, kind).first()["modularity"], 0.5)
    one = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "node string, label string")
    assert math.isclose(C.modularity(hg(spark, e1="abc"), one).first()["modularity"], 2 / 3 - 7 / 9)


@pytest.mark.parametrize(("triples", "yto"), [(["123", "124"], (1, 0, 0)), (["123", "124", "134"], (0, 1, 0)), (["123", "124", "134", "234"], (0, 0, 1))])
def test_motifs(spark, triples, yto):
    assert tuple(S.triple_motifs(hg(spark, **{f"e{t}": t for t in triples})).first()) == yto


def test_agreement_reference_values(spark):
    lab = lambda f, n: spark.createDataFrame([(i, f(i)) for i in range(1, n + 1)], "node int, label int")
    r = C.agreement(lab(lambda i: i % 6, 200), lab(lambda i: i // 5 % 6, 200)).first()
    assert math.isclose(r["ari"], 0.0156624767712796, rel_tol=1e-9) and math.isclose(r["ami"], 0.0679455245479407, rel_tol=1e-9) and math.isclose(r["nmi"], 0.102101678811944, rel_tol=1e-9)
    same = C.agreement(lab(lambda i: i % 3, 30), lab(lambda i: (i + 1) % 3, 30)).first()
    assert (same["ari"], same["ami"], same["nmi"]) == (1, 1, 1)


def test_components_and_pagerank(spark):
    m = hg(spark, e1="ab", e2="bc", e3="xy")
    c = {r["name"]: r["component"] for r in S.components(m).where("kind = 'node'").collect()}
    assert c == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    r = {x["node"]: x["pagerank"] for x in P.pagerank(m, iterations=40).collect()}
    assert math.isclose(sum(r.values()), 1) and r["b"] > r["a"]


def test_labels_spread(spark):
    m = hg(spark, e1="abc", e2="cd", e3="xyz")
    lab = spark.createDataFrame([("a", "l"), ("x", "r")], "node string, label string")
    r = {x["node"]: x["predicted"] for x in P.spread_labels(m, lab, iterations=30).collect()}
    assert r == {"a": "l", "b": "l", "c": "l", "d": "l", "x": "r", "y": "r", "z": "r"}


def test_hypergeometric_and_adjustment(spark):
    choose = math.comb
    exact = lambda x: choose(30, x) * choose(70, 20 - x) / choose(100, 20)
    for x in range(21):
        lo, up = hypergeometric_tail(x, 30, 100, 20)
        assert math.isclose(lo, sum(map(exact, range(x + 1))), rel_tol=1e-9) and math.isclose(up, sum(map(exact, range(x, 21))), rel_tol=1e-9)
    df = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,)], "p double")
    assert [round(r["q"], 6) for r in p_adjust(df, "p", "q").orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]
    assert [round(r["q"], 6) for r in p_adjust(df, "p", "q", "holm").orderBy("p").collect()] == [0.04, 0.06, 0.06, 0.5]


def test_pair_anomaly_finds_a_planted_pair(spark):
    import random

    rnd = random.Random(3)
    edges = {f"e{i}": set(rnd.sample("abcdefgh", 3)) for i in range(130)} | {f"p{i}": {"x", "y"} for i in range(25)} | {f"q{i}": {"x", "a"} for i in range(3)}
    r = S.pair_anomaly(hg(spark, **edges)).where("anomaly = 'over'").collect()
    assert ("x", "y") in {(x["node_a"], x["node_b"]) for x in r} and all(x["ratio"] > 1 for x in r)


def test_triangles_are_counted_by_groups_of_nodes(spark, monkeypatch):
    from itertools import combinations

    import numpy as np

    rng = np.random.default_rng(4)
    near = np.triu(rng.random((40, 40)) < 0.3, 1)
    monkeypatch.setattr(S, "TRIANGLE_PAIRS", 50)  # several tasks, no two-path joined
    p = spark.createDataFrame([(int(a), int(b)) for a, b in zip(*np.nonzero(near))], "a long, b long")
    want = np.zeros(40, int)
    for t in combinations(range(40), 3):
        if all(near[x] for x in combinations(t, 2)):
            want[list(t)] += 1
    got = S.triangles(p)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert dict(map(tuple, got.collect())) == dict(enumerate(want.tolist()))


def test_louvain_takes_any_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 7)
    monkeypatch.setattr(C, "MAX_SEARCH", 5, raising=False)  # the guard there was
    cliques = [(f"n{5 * g + i:02d}", f"n{5 * g + j:02d}", 1.0) for g in range(4) for i in range(5) for j in range(i)]
    bridges = [(f"n{5 * g:02d}", f"n{5 * ((g + 1) % 4):02d}", 0.5) for g in range(4)]
    got = {r["node"]: r["label"] for r in C.louvain(spark.createDataFrame(cliques + bridges, "node_a string, node_b string, weight double")).collect()}
    assert got == {f"n{k:02d}": k // 5 + 1 for k in range(20)}
