import numpy as np
import pytest

from polyad.llm import neighbours as N

SCHEMA = "emb_id long, embeddings array<float>, id string, v string"


def brute(ids, x, k, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[int(ids[i])] = [int(ids[j]) for j in order if s[i, j] >= least]
    return out


def run(spark, ids, x, **how):
    rows = [(int(i), None if v is None else [float(y) for y in v], "clash", "clash") for i, v in zip(ids, x, strict=True)]
    got = {}
    for r in N.similar_vectors(spark.createDataFrame(rows, SCHEMA), **how).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    return got


@pytest.mark.parametrize("block", [8192, 60])
def test_recall_and_order(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(1)
    cen = rng.standard_normal((12, 64))
    x = (cen[rng.integers(0, 12, 900)] + rng.standard_normal((900, 64)) * rng.choice([0.2, 0.5], (900, 1))).astype(np.float32)
    x *= rng.lognormal(size=(900, 1)).astype(np.float32)
    ids = rng.permutation(5000)[:900]
    want, got = brute(ids, x, 5, 0.5), run(spark, ids, x, k=5, least=0.5, list_rows=60)
    pairs = lambda d: {(a, b) for a, bs in d.items() for b in bs}
    assert len(pairs(want) & pairs(got)) >= 0.97 * len(pairs(want))
    exact = run(spark, ids, x, k=5, least=0.5, list_rows=60, margin=9.0, probes=999)
    assert exact == {k: v for k, v in want.items() if v}


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((3, 64)).astype(np.float32)
    x = [base[0]] * 40 + [base[1], base[1] * 4, base[2], None, np.zeros(64), np.full(64, np.nan), base[0][:63], []]
    got = run(spark, range(len(x)), x, k=5, least=0.8)
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[39] == [0, 1, 2, 3, 4]
    assert got[40] == [41] and got[41] == [40] and 42 not in got and not set(got) & set(range(43, 48))


def test_repeated_rows_and_empty(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal(64).astype(np.float32)
    assert run(spark, [1, 1, 2], [a, a, a * 2], k=5) == {1: [2], 2: [1]}
    assert run(spark, [], []) == {}


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    data, ask = unit(rng.standard_normal((500, 64)) + 1), unit(rng.standard_normal((50, 64)) + 1)
    est, bound = N.Codes(data, data.mean(0), 7).estimate(ask)
    err = np.abs(est - ask @ data.T)
    assert (err <= bound).mean() > 0.9 and abs((est - ask @ data.T).mean()) < 0.01
