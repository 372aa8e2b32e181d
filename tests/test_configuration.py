"""The null test deals its draws in tasks: parts of them against brute force and against the draws as rows."""

from collections import Counter
from itertools import combinations, pairwise

import numpy as np
import pytest

from polyad.operators import configuration as C
from polyad.operators import structure as S

NAMES = ["density", "avg_size", "avg_jaccard", "participation", "repeated_edges", "repeated_pairs"]


def made(seed, nodes, edges, most):
    rng, p = np.random.default_rng(seed), 1.0 / np.arange(1, nodes + 1)
    return {f"e{j}": {f"n{x}" for x in rng.choice(nodes, rng.integers(1, most + 1), replace=False, p=p / p.sum())} for j in range(edges)}


def frame(spark, sets):
    return spark.createDataFrame([(n, e, 1.0) for e, ns in sets.items() for n in ns], "node string, edge string, weight double")


def brute(sets):
    c = Counter(p for s in sets for p in combinations(sorted(s), 2))
    jaccard = sum(len(a & b) / len(a | b) for a, b in combinations(sets, 2))
    return [sum(map(len, sets)), len(sets) - len(set(map(frozenset, sets))), len(c), sum(k > 1 for k in c.values()), jaccard]


def ratios(sets):
    cells, equal, pairs, again, jaccard = brute(sets)
    n, m = len(set().union(*sets)), len(sets)
    return [cells / (n * m), cells / m, jaccard / (m * (m - 1) / 2), pairs / (n * (n - 1) / 2), equal, again]


@pytest.mark.parametrize("n", [1, 2, 5, 97, 70_001])
@pytest.mark.parametrize("table", [0, 1 << 20])
def test_permutations_are_followed_both_ways(n, table):
    p, x = C.Permutation(n, -3, 2, table), np.arange(n)
    assert np.array_equal(np.sort(p.to(x)), x) and np.array_equal(p.of(p.to(x)), x)


@pytest.mark.parametrize("table", [0, 1 << 20])
def test_parts_of_a_draw_add_up(table, monkeypatch):
    sets = made(5, 30, 60, 7)
    size = sorted(map(len, sets.values()))
    degree = sorted(Counter(n for s in sets.values() for n in s).values())
    nodes, edges = C.Runs(list(Counter(degree).items())), C.Runs(list(Counter(size).items()))
    p = C.Permutation(nodes.stubs, 1, 1, table)
    node, edge, draw = np.repeat(np.arange(len(degree)), degree), np.repeat(np.arange(len(size)), size), [set() for _ in size]
    for j, i in enumerate(p.to(np.arange(nodes.stubs))):
        draw[edge[i]].add(int(node[j]))
    for cuts, block in (([0, nodes.items], 1 << 19), ([0, 4, 5, 20, nodes.items], 7)):
        monkeypatch.setattr(C, "BLOCK", block)
        monkeypatch.setattr(C._blocks, "__defaults__", (block,))
        got = np.sum([C.part_of_draw(nodes, edges, p, a, z) for a, z in pairwise(cuts)], 0)
        assert np.allclose([*got[:4], got[4] + got[5]], brute(draw))


def test_null_test_makes_no_rows_of_its_draws(spark, monkeypatch):
    sets = made(7, 12, 25, 5)
    rows = S.null_statistics(S.configuration_draws(frame(spark, sets), 19, 4), ["replicate"]).collect()

    def refuse(*a):
        raise AssertionError("draws as rows")

    monkeypatch.setattr(S, "configuration_draws", refuse)
    got = {r["statistic"]: r for r in S.null_test(frame(spark, sets), 19, 4).collect()}
    assert np.allclose([got[x]["observed"] for x in NAMES], ratios(list(sets.values())))
    for x in NAMES:
        null = [float(r[x]) for r in rows]
        assert np.isclose(got[x]["null_mean"], np.mean(null)) and np.isclose(got[x]["null_sd"], np.std(null, ddof=1))


def test_buckets_and_ranges_do_not_change_the_sums(spark):
    sets = made(9, 40, 50, 6) | {"same": {"n0", "n1"}, "again": {"n1", "n0"}, "alone": {"n0"}}
    one, nodes, edges = C.observed_sums(frame(spark, sets))
    for row in (one.first(), C.observed_sums(frame(spark, sets), 9)[0].first()):
        assert np.allclose([*row[2:6], row["js"] + row["more"]], brute(list(sets.values())))
    whole, parted = (sorted(map(tuple, C.draw_sums(spark, nodes, edges, 3, 1, k).select("replicate", "n", "m", "cells", "repeated_edges", "pairs", "repeated_pairs", (C.F.col("js") + C.F.col("more")).alias("o")).collect())) for k in (C.PAIRS_PER_TASK, 20))
    assert len(whole) == 3 and np.allclose(whole, parted)


def test_repeated_rows_count_once_and_nulls_not(spark):
    sets = made(13, 10, 12, 4)
    m = frame(spark, sets)
    row = C.observed_sums(m.union(m).union(spark.createDataFrame([(None, "e0", 1.0), ("n0", None, 1.0)], m.schema)))[0].first()
    assert np.allclose([*row[2:6], row["js"] + row["more"]], brute(list(sets.values())))


def test_draws_as_rows_are_not_ordered_in_one_task(spark):
    sets = made(11, 15, 20, 5)
    draws = S.configuration_draws(frame(spark, sets), 2)
    assert "Window" not in draws._jdf.queryExecution().toString()
    assert {r["edge"] for r in draws.collect()} == sets.keys() and {r["node"] for r in draws.collect()} == set().union(*sets.values())
