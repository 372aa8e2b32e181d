import random
from itertools import combinations

from polyad.llm import cooccurrence as M
from polyad.llm.cooccurrence import memberships, named_pairs, pair_counts


def brute(rows, least, lift):
    sets = {}
    for g, e, i in rows:
        if None not in (g, e, i):
            sets.setdefault((g, e), set()).add(i)
    out = set()
    for g in {k[0] for k in sets}:
        own = [s for k, s in sets.items() if k[0] == g]
        for a, b in combinations(sorted(set().union(*own)), 2):
            c, da, db = sum({a, b} <= s for s in own), sum(a in s for s in own), sum(b in s for s in own)
            if c >= max(1, least) and c * len(own) >= lift * da * db:
                out.add((g, a, b, c, da, db, len(own)))
    return out


def rows_of(seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("gh"), f"e{rnd.randrange(150)}", min(int(rnd.expovariate(0.15)), 40)) for _ in range(1500)]
    rows += [("g", "big", i) for i in range(40)] + [("g", "e1", None), (None, "e1", 3), ("h", None, 3)]
    return rows + rows[:100]


def got(df):
    return {(r["hg"], r["item_a"], r["item_b"], r["n_both"], r["n_a"], r["n_b"], r["n_baskets"]) for r in df.collect()}


def test_pairs_and_blocks(spark, monkeypatch):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "hg string, edge string, item int")
    assert got(pair_counts(df)) == brute(rows, 1, 0)
    monkeypatch.setattr(M, "BLOCK", 7)
    assert got(pair_counts(df, min_count=3, min_lift=1.5)) == brute(rows, 3, 1.5)


def test_one_very_large_edge_is_spread(spark):
    df = spark.range(900).selectExpr("'g' hg", "'e' edge", "cast(id as int) item").union(spark.sql("select 'g', 'f', 7 union all select 'g', 'f', 8"))
    r = pair_counts(df)
    assert r.count() == 900 * 899 // 2 and [x["item_a"] for x in r.where("n_both = 2").collect()] == [7]


def test_lift_conviction_and_empty(spark):
    df = spark.createDataFrame([("g", "1", 1), ("g", "1", 2), ("g", "2", 1), ("g", "2", 2), ("g", "3", 2), ("g", "4", 3)], "hg string, edge string, item int")
    r = pair_counts(df).first()
    assert r["lift"] == 2 * 4 / (2 * 3) and r["conviction_ab"] == float("inf") and abs(r["conviction_ba"] - (1 - 2 / 4) / (1 / 3)) < 1e-12
    assert pair_counts(df.limit(0)).count() == 0


def test_memberships_of_two_exports(spark):
    nodes = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "")], "node_idx int, node string")
    h = spark.createDataFrame([("g", "e", [1, 1, None, 9]), ("g", "f", None), (None, "e", [1])], "hg string, edge string, hyperedges array<int>")
    i = spark.createDataFrame([("g", "e", "a", 0.0), ("g", "f", "a", None), ("g", "f", "b", 2.0), ("g", "f", "zz", 1.0)], "hg string, edge string, node string, weight double")
    m = memberships(h, i, nodes)
    assert {tuple(r) for r in m.collect()} == {("g", "e", 1), ("g", "f", 2), ("g", "f", 1)}
    r = named_pairs(pair_counts(m), nodes).first()
    assert (r["node_a"], r["node_b"], r["n_both"]) == ("a", "b", 1)
