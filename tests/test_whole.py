"""Registered queries take the whole of their tables: brute force on small fixtures."""

from itertools import combinations

import numpy as np
import pytest

from polyad import catalogue as Q
from polyad.operators import structure as S

#: (part, supplier, order, quantity): an order has several sizes of line, so that a cut by quantity would show
LINES = [(1, 1, 10, 50), (2, 2, 10, 3), (3, 3, 10, 45), (1, 1, 11, 7), (2, 2, 11, 50), (4, 3, 12, 1), (5, 4, 12, 50), (3, 1, 13, 46), (1, 2, 13, 2), (2, 3, 13, 9), (6, 5, 14, 50), (6, 4, 15, 4)]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("lines")
    spark.createDataFrame([(*r[:3], float(r[3])) for r in LINES], "l_partkey long, l_suppkey long, l_orderkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def members(column):
    out = {}
    for r in LINES:
        out.setdefault(str(r[2]), set()).add(str(r[column]))
    return out


def brute_components(edges):
    label = {n: n for e in edges.values() for n in e}
    for _ in label:
        for e in edges.values():
            least = min(label[n] for n in e)
            label |= dict.fromkeys(e, least)
    return label


def brute_null(edges):
    sets, nodes = list(edges.values()), set().union(*edges.values())
    n, m, cells = len(nodes), len(sets), sum(map(len, sets))
    jaccard = [len(a & b) / len(a | b) for a, b in combinations(sets, 2)]
    shared = [sum({a, b} <= e for e in sets) for a, b in combinations(sorted(nodes), 2)]
    return [cells / (n * m), cells / m, np.mean(jaccard), sum(c > 0 for c in shared) / (n * (n - 1) / 2), m - len(set(map(frozenset, sets))), sum(c > 1 for c in shared)]


def test_components_of_all_lines(spark, lines):
    edges = members(0)
    label = brute_components(edges)
    want = {("node", n, c) for n, c in label.items()} | {("edge", e, label[min(ns)]) for e, ns in edges.items()}
    assert set(map(tuple, Q.connected_components(spark, lines).collect())) == want
    assert {r["component"]: (r["n_nodes"], r["n_edges"]) for r in Q.component_table(spark, lines).collect()} == {c: (sum(x == c for x in label.values()), sum(label[min(ns)] == c for ns in edges.values())) for c in set(label.values())}


def test_null_statistics_of_all_lines(spark, lines):
    assert np.allclose(list(Q.null_statistics(spark, lines).first()), brute_null(members(0)), atol=1e-6)
    names = ["density", "avg_size", "avg_jaccard", "participation", "repeated_edges", "repeated_pairs"]
    got = {r["statistic"]: r["observed"] for r in Q.null_test_configuration(spark, lines).collect()}
    assert np.allclose([got[x] for x in names], brute_null(members(0)))


def test_null_statistics_of_replicates_with_large_overlaps(spark):
    rng = np.random.default_rng(3)
    made = {k: {f"e{j}": set(rng.choice(list("abcdefgh"), rng.integers(1, 7), replace=False).tolist()) for j in range(9)} for k in (1, 2)}
    m = spark.createDataFrame([(k, n, e) for k, es in made.items() for e, ns in es.items() for n in ns], "replicate int, node string, edge string")
    for r in S.null_statistics(m, ["replicate"]).collect():
        assert np.allclose(list(r)[1:], brute_null(made[r["replicate"]]))


def test_supplier_measures_of_all_lines(spark, lines):
    edges = members(1)
    own = {n: {e for e, ns in edges.items() if n in ns} for n in set().union(*edges.values())}
    near = {n: set().union(*(edges[e] for e in es)) - {n} for n, es in own.items()}
    closed = {n: sum(b in near[a] for a, b in combinations(o, 2)) for n, o in near.items()}
    want = {n: round(closed[n] / (len(o) * (len(o) - 1) / 2), 6) if len(o) > 1 else None for n, o in near.items()}
    assert dict(map(tuple, Q.transitivity_projection(spark, lines).collect())) == want
    for kind, below in (("union", lambda a, b: len(a | b)), ("min", lambda a, b: min(len(a), len(b))), ("max", lambda a, b: max(len(a), len(b)))):
        want = {n: round(np.mean([len(own[n] & own[o]) / below(own[n], own[o]) for o in os]), 6) if os else None for n, os in near.items()}
        got = dict(map(tuple, Q.QUERIES[f"transitivity_two_node_{kind}"](spark, lines).collect()))
        assert got.keys() == want.keys() and all(np.isclose(got[n] or 0, v or 0, atol=2e-6) for n, v in want.items())


def test_laplacian_of_all_lines(spark, lines):
    edges = members(1)
    nodes = sorted(set().union(*edges.values()))
    h = np.array([[n in e for e in edges.values()] for n in nodes], float)
    d, k = h.sum(1), h.sum(0)
    want = np.eye(len(nodes)) - h / np.sqrt(d)[:, None] / k @ (h / np.sqrt(d)[:, None]).T
    for r in Q.laplacian_zhou(spark, lines).collect():
        assert np.isclose(r["value"], want[nodes.index(r["i"]), nodes.index(r["j"])], atol=1e-6)


@pytest.mark.parametrize("wide", [True, False])
def test_coclusters_of_a_wide_and_of_a_tall_matrix(spark, wide):
    from polyad.operators import factor as L

    cells = [(f"n{i:05d}", f"e{j:05d}", 1.0) for i in range(8) for j in range(6000) if (i < 4) == (j < 3000) and (7 * i + 3 * j) % 5 or (i, j) in ((0, 4000), (1, 4001))]
    m = spark.createDataFrame([(a, b, w) if wide else (b, a, w) for a, b, w in cells], "node string, edge string, weight double")
    got = {r["name"]: r["cluster"] for r in L.cocluster(m, 2).collect()}
    assert len(got) == 6008 and all(len({c for x, c in got.items() if x[0] == "n" and (int(x[1:]) < 4) == half}) == 1 for half in (True, False))
    assert got["n00000"] != got["n00007"] and got["e00000"] == got["n00000"] and got["e05999"] == got["n00007"]


def test_complex_of_a_five_clique_and_faces_of_a_large_set(spark):
    from polyad.operators import simplicial as K

    edges = spark.createDataFrame([(a, b, 1.0) for a, b in combinations("abcde", 2)], "a string, b string, weight double")
    sc = K.cliques(edges, None)
    assert {r["dimension"]: r["n"] for r in K.f_vector(sc).collect()} == {0: 5, 1: 10, 2: 10, 3: 5, 4: 1}
    assert K.euler(sc).first()[0] == 1
    big = spark.createDataFrame([([f"v{i:02d}" for i in range(18)], 2)], "members array<string>, count int")
    assert {r["dimension"]: r["n"] for r in K.f_vector(K.close(big, 2)).collect()} == {0: 18, 1: 153, 2: 816}


H = [["a", "b", "c"], ["b", "c", "d"], ["d", "e"], ["a", "e"], ["e", "f", "g"]]


def small(spark):
    return spark.createDataFrame([(n, f"h{j}", 1.0) for j, e in enumerate(H) for n in e], "node string, edge string, weight double")


def test_walks_at_their_fixed_points(spark):
    from polyad.errors import NoConverge
    from polyad.operators import spectral as P

    nodes = sorted({n for e in H for n in e})
    h = np.array([[n in e for e in H] for n in nodes], float)
    d, k = h.sum(1), h.sum(0)
    walk = (h / d[:, None]) @ (h / k).T
    r = np.linalg.solve(np.eye(len(nodes)) - 0.85 * walk.T, np.full(len(nodes), 0.15 / len(nodes)))
    got = dict(map(tuple, P.pagerank(small(spark)).collect()))
    assert np.allclose([got[n] for n in nodes], r / r.sum(), atol=1e-9)
    a = h @ h.T - np.diag(d)
    alpha = 0.5 / a.sum(1).max()
    got = dict(map(tuple, P.katz(small(spark)).collect()))
    assert np.allclose([got[n] for n in nodes], np.linalg.solve(np.eye(len(nodes)) - alpha * a, alpha * a.sum(1)), atol=1e-9)
    with pytest.raises(NoConverge):
        P.katz(small(spark), 0.9, iterations=12)
    with pytest.raises(NoConverge):
        P.pagerank(small(spark), iterations=4)
    s = (h / np.sqrt(d)[:, None] / k) @ (h / np.sqrt(d)[:, None]).T
    y = np.zeros((len(nodes), 2))
    y[0, 0] = y[6, 1] = 0.1
    f = np.linalg.solve(np.eye(len(nodes)) - 0.9 * s, y)
    seeds = spark.createDataFrame([("a", "0"), ("g", "1")], "node string, label string")
    got = {x["node"]: (x["predicted"], x["score"]) for x in P.spread_labels(small(spark), seeds, xi=0.9).collect()}
    assert all(got[n][0] == str(f[i].argmax()) and np.isclose(got[n][1], f[i].max(), atol=1e-7) for i, n in enumerate(nodes))
    top = dict(map(tuple, P.clique_eigenvector(small(spark)).collect()))
    w, v = np.linalg.eigh((a > 0).astype(float))
    assert np.allclose([top[n] for n in nodes], np.abs(v[:, -1]), atol=1e-6)


def test_large_edges_and_popular_nodes_are_paired_in_blocks(spark, monkeypatch):
    want = sorted(map(tuple, S.node_pairs(small(spark)).select("edge", "node_a", "node_b").collect()))
    over = sorted(map(tuple, S.edge_overlaps(small(spark)).select("edge_a", "edge_b", "overlap").collect()))
    monkeypatch.setattr(S, "PAIR_BLOCK", 1)
    assert sorted(map(tuple, S.node_pairs(small(spark)).select("edge", "node_a", "node_b").collect())) == want
    assert sorted(map(tuple, S.edge_overlaps(small(spark)).select("edge_a", "edge_b", "overlap").collect())) == over


def test_ranks_over_partitions(spark):
    from polyad.plans.rank import numbered

    df = spark.range(1000).selectExpr("id", "(id * 37) % 101 as v").repartition(7)
    got = numbered(df, "v", "id").orderBy("rank").collect()
    assert [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got) and [r["rank"] for r in got] == list(range(1, 1001))
    assert numbered(df.limit(0), "v", "id").count() == 0
