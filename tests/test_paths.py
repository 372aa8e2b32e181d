"""Shortest paths, overlap beyond shared nodes, groups and ranks against brute force."""

import random
from collections import deque
from itertools import combinations

import numpy as np
import pytest

from polyad.errors import BadInput
from polyad.functions.stats import hypergeometric_tail, hypergeometric_tail_arrays, p_adjust
from polyad.operators import paths
from polyad.operators import sequences as Q
from polyad.operators import structure as S

EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("x", "y")]
NODES = sorted({n for e in EDGES for n in e} | {"lone"})


def walks(links, s):
    dist, sigma, todo = {s: 0}, {s: 1}, deque([s])
    while todo:
        u = todo.popleft()
        for v in sorted(b for a, b in links if a == u):
            if v not in dist:
                dist[v], sigma[v] = dist[u] + 1, 0
                todo.append(v)
            if dist[v] == dist[u] + 1:
                sigma[v] += sigma[u]
    return dist, sigma


@pytest.mark.parametrize("directed", [False, True])
def test_closeness_and_betweenness(spark, directed):
    links = EDGES if directed else EDGES + [(b, a) for a, b in EDGES]
    info = {s: walks(links, s) for s in NODES}
    want = dict.fromkeys(NODES, 0.0)
    for s in NODES:
        for t in NODES:
            for v in NODES:
                if len({s, t, v}) == 3 and t in info[s][0] and v in info[s][0] and t in info[v][0] and info[s][0][v] + info[v][0][t] == info[s][0][t]:
                    want[v] += info[s][1][v] * info[v][1][t] / info[s][1][t]
    df, nodes = spark.createDataFrame([*links, ("a", "a"), ("a", "b")], "a string, b string"), spark.createDataFrame([(n,) for n in NODES], "node string")
    got = dict(map(tuple, paths.betweenness(df, nodes, directed, normalised=False).collect()))
    assert all(np.isclose(got[n], want[n] * (1 if directed else 0.5)) for n in NODES)
    near = dict(map(tuple, paths.closeness(df, nodes).collect()))
    for n in NODES:
        d = info[n][0].values()
        r = len(d) - 1
        assert np.isclose(near[n], r / sum(d) * r / (len(NODES) - 1) if r else 0.0)
    assert paths.betweenness(df.limit(0), nodes).count() == len(NODES) and paths.closeness(df, nodes.limit(0)).count() == 0


def test_extra_overlap(spark):
    rnd = random.Random(3)
    hyper = {f"h{j}": set(rnd.sample("abcdefghij", rnd.randint(1, 5))) for j in range(8)} | {"twin": set("ab"), "twin2": set("ab"), "one": {"z"}}
    near = {n: set().union(*(e for e in hyper.values() if n in e)) - {n} for e in hyper.values() for n in e}

    def eo(e, f):
        d1, d2 = e - f, f - e
        if not d1 | d2:
            return 0.0
        return (sum(bool(near[x] & d1) for x in d2) + sum(bool(near[x] & d2) for x in d1)) / (len(d1) + len(d2))

    m = spark.createDataFrame([(n, h, 1.0) for h, e in hyper.items() for n in e], "node string, edge string, weight double")
    got = dict(map(tuple, S.extra_overlap_transitivity(m).collect()))
    for n in near:
        own = [e for e in hyper.values() if n in e]
        pairs = list(combinations(own, 2))
        assert np.isclose(got[n], sum(eo(a, b) for a, b in pairs) / len(pairs) if pairs else 0.0)


def test_tails_of_arrays_and_adjustment(spark):
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 30), rnd.randint(0, 40), 60, rnd.randint(0, 60)) for _ in range(300)] + [(5, 100_000, 10**8, 4000)]
    lower, upper = hypergeometric_tail_arrays(*zip(*rows, strict=True))
    want = [hypergeometric_tail(*r) for r in rows]
    assert np.allclose(lower, [w[0] for w in want], rtol=1e-9) and np.allclose(upper, [w[1] for w in want], rtol=1e-9)
    p = [rnd.choice([0.01, 0.02, 0.02, rnd.random()]) for _ in range(60)]
    n, df = len(p), spark.createDataFrame([(float(x),) for x in p] + [(None,)], "p double")
    order = sorted(p)
    bh = {x: min(min(1.0, order[k] * n / (k + 1)) for k in range(n) if order[k] >= x) for x in p}
    holm = {x: max(min(1.0, order[k] * (n - k)) for k in range(n) if order[k] <= x) for x in p}
    hoch = {x: min(min(1.0, order[k] * (n - k)) for k in range(n) if order[k] >= x) for x in p}
    for method, want in (("BH", bh), ("holm", holm), ("hochberg", hoch)):
        got = p_adjust(df, "p", "q", method).collect()
        assert len(got) == n + 1 and all((r["q"] is None) if r["p"] is None else np.isclose(r["q"], want[r["p"]]) for r in got)
    with pytest.raises(BadInput):
        p_adjust(df, "p", "q", "other")


def test_rules_of_groups_are_those_of_each_alone(spark):
    rnd = random.Random(6)
    rows = [(f"s{k}", i + 1, rnd.choice("ab" if k % 2 else "abc")) for k in range(12) for i in range(25)]
    seqs = spark.createDataFrame(rows, "seq_id string, pos int, state string")
    groups = spark.createDataFrame([(f"s{k}", "odd" if k % 2 else "even") for k in range(11)] + [("s11", None)], "seq_id string, grp string")
    key = lambda r: (tuple(r["context"]), r["target"], r["count"])
    got = Q.memory_rules_by_group(seqs, groups, 3).collect()
    for g in ("odd", "even"):
        own = seqs.join(groups.where(f"grp = '{g}'").select("seq_id"), "seq_id")
        assert sorted(key(r) for r in got if r["grp"] == g) == sorted(key(r) for r in Q.memory_rules(own, 3).collect())


def test_order_zero_and_documents(spark):
    seqs = spark.createDataFrame([("s", i + 1, x) for i, x in enumerate("aabab")], "seq_id string, pos int, state string")
    r = Q.model_scores(seqs, 1, from_order=0).where("order = 0").first()
    assert np.isclose(r["log_likelihood"], 3 * np.log(0.6) + 2 * np.log(0.4)) and (r["parameters"], r["n"]) == (1, 5)
    docs = spark.createDataFrame([("d2", "u", 1, "y"), ("d1", "u", 1, "x"), ("d3", "u", 0, "z")], "doc_id string, who string, turn int, phase string")
    assert [(x["pos"], x["state"]) for x in Q.from_documents(docs, "who", "turn", "phase").orderBy("pos").collect()] == [(1, "z"), (2, "x"), (3, "y")]
    with pytest.raises(BadInput):
        Q.from_documents(docs.selectExpr("doc_id", "who", "turn", "cast(null as string) phase"), "who", "turn", "phase")


def test_extra_overlap_of_random_edges(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    e = {f"e{j:02d}": set(rng.choice(12, rng.integers(1, 6), replace=False).tolist()) for j in range(14)}
    near = {(x, y) for s in e.values() for x in s for y in s if x != y}
    m = spark.createDataFrame([(f"n{x:02d}", k, 1.0) for k, s in e.items() for x in s], "node string, edge string, weight double")
    got = S.extra_overlap(m)
    for r in got.collect():
        a, b = e[r["edge_a"]] - e[r["edge_b"]], e[r["edge_b"]] - e[r["edge_a"]]
        hits = sum(any((x, y) in near for y in b) for x in a) + sum(any((x, y) in near for y in a) for x in b)
        assert np.isclose(r["overlap_beyond"], hits / len(a | b) if a | b else 0.0)
    assert "leftsemi" not in got._jdf.queryExecution().optimizedPlan().toString().lower()  # no row for each two edges, member and neighbour
