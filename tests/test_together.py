"""Verbs that pass over memberships in barrier tasks, against dense matrices held whole."""

import numpy as np
import pytest

from polyad.operators import factor as L
from polyad.operators import spectral as P
from polyad.operators import text as X
from polyad.plans import together as T


@pytest.fixture(scope="module")
def made(spark):
    """Four groups of ten nodes with 300 edges of three members, 30 of them across groups."""
    rng = np.random.default_rng(7)
    sets = [sorted(rng.choice(40, 3, replace=False)) if j % 10 == 0 else sorted(rng.choice(10, 3, replace=False) + 10 * (j % 4)) for j in range(300)]
    h = np.zeros((40, 300))
    for j, s in enumerate(sets):
        h[s, j] = 1
    m = spark.createDataFrame([(f"n{i:02d}", f"e{j:03d}", 1.0) for j, s in enumerate(sets) for i in s], "node string, edge string, weight double").repartition(3)
    d, c = h.sum(1), h.sum(0)
    a = h / np.sqrt(d)[:, None] / np.sqrt(c)
    return m, h, a @ a.T


@pytest.fixture(params=[1, 4])
def tasks(request, monkeypatch):
    monkeypatch.setattr(T, "CELLS_PER_TASK", 10**9 if request.param == 1 else 225)
    monkeypatch.setattr(T, "BLOCK", 60)
    monkeypatch.setattr(T, "PIECE", 16)


def test_leading_vectors_and_spectral_clusters(spark, made, tasks, monkeypatch):
    m, _, s = made
    val, u = T.leading(T.Group(), lambda x: x @ s, 40, 4, 1)
    want, vec = np.linalg.eigh(s)
    assert np.allclose(val, want[::-1][:4]) and np.allclose(np.abs((u @ vec[:, ::-1][:, :4]).diagonal()), 1, atol=1e-6)
    monkeypatch.setattr(P, "MAX_DENSE", 39)  # beyond what the dense verbs take
    got = {r["node"]: r["cluster"] for r in P.spectral_clusters(m, 4).collect()}
    assert len(got) == 40 and len(set(got.values())) == 4
    assert all(len({got[f"n{10 * g + i:02d}"] for i in range(10)}) == 1 for g in range(4))


def test_a_krylov_basis_is_restarted_and_finds_equal_values():
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((900, 900)))[0]
    want = np.r_[np.ones(6), np.linspace(0.9, 0, 894)]
    s = (q * want) @ q.T
    val, u = T.leading(T.Group(), lambda x: x @ s, 900, 4, 1)
    assert np.allclose(val, 1) and np.allclose(u @ s, u, atol=1e-7) and np.allclose(u @ u.T, np.eye(4), atol=1e-7)
    val, u = T.leading(T.Group(), lambda x: x @ s, 900, 9, 1)
    assert np.allclose(val, want[:9]) and np.allclose(u @ s, val[:, None] * u, atol=1e-7)


def test_symmetric_nmf_of_the_memberships(spark, made, tasks):
    m, _, s = made
    best, want = np.inf, None
    for t in range(2):
        h = np.random.default_rng(1 + t).random((40, 3)) * 2 * np.sqrt(s.mean() / 3)
        for _ in range(50):
            h = h * (0.5 + 0.5 * (s @ h) / np.maximum(h @ (h.T @ h), 1e-12))
        if (cost := ((s - h @ h.T) ** 2).sum()) < best:
            best, want = cost, h / h.sum(1, keepdims=True)
    got = {r["node"]: (r["cluster"], r["membership"]) for r in L.symmetric_nmf(m, 3, starts=2, rounds=50).collect()}
    assert all(got[f"n{i:02d}"][0] == want[i].argmax() + 1 and np.isclose(got[f"n{i:02d}"][1], want[i].max()) for i in range(40))


def test_block_model_of_the_memberships(spark, made, tasks):
    m, b, _ = made
    best, want = -np.inf, None
    for t in range(2):
        rng = np.random.default_rng(1 + t)
        u, w, last = rng.random((40, 3)) + 0.1, rng.random(3) + 0.1, -np.inf
        pair = lambda u: np.maximum(((b.T @ u) ** 2 - b.T @ u**2) / 2, 0)
        for _ in range(20):
            lam, tot, was = np.maximum(pair(u) @ w, 1e-12), u.sum(0), w
            ll = np.log(lam).sum() - ((tot**2 - (u**2).sum(0)) / 2 * w).sum()
            assert ll >= last - 1e-6
            last = ll
            num = (b / lam) @ (b.T @ u) - (b / lam).sum(1)[:, None] * u
            w = w * (pair(u) / lam[:, None]).sum(0) / ((tot**2 - (u**2).sum(0)) / 2)
            u = u * np.sqrt(num * was / np.maximum(w * (tot - u), 1e-12))
        ll = np.log(np.maximum(pair(u) @ w, 1e-12)).sum() - ((u.sum(0) ** 2 - (u**2).sum(0)) / 2 * w).sum()
        if ll > best:
            best, want = ll, u / np.maximum(u.sum(1, keepdims=True), 1e-12)
    for r in L.block_model(m, 3, starts=2, rounds=20).collect():
        assert np.isclose(r["membership"], want[int(r["node"][1:]), r["community"] - 1], atol=1e-6)


def test_coclusters_in_tasks(spark, made, tasks):
    m, h, _ = made
    got = {(r["kind"], r["name"]): r["cluster"] for r in L.cocluster(m, 4).collect()}
    assert len(got) == 340 and got["node", "n00"] == 1 and set(got.values()) == {1, 2, 3, 4}
    groups = [{got["node", f"n{10 * g + i:02d}"] for i in range(10)} for g in range(4)]
    assert all(len(g) == 1 for g in groups)
    own = [j for j in range(300) if j % 10]
    assert all(got["edge", f"e{j:03d}"] in groups[j % 4] for j in own)


def test_topics_in_tasks(spark, tasks):
    rng = np.random.default_rng(5)
    x = rng.poisson(0.6, (60, 30)) + np.kron(np.eye(2), rng.poisson(2, (30, 15)))
    b = spark.createDataFrame([(f"d{i:02d}", f"w{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "doc string, word string, weight double").repartition(3)
    best, want = np.inf, None
    for t in range(2):
        r = np.random.default_rng(1 + t)
        w, h = r.random((60, 3)) + 0.1, r.random((3, 30)) + 0.1
        for _ in range(30):
            w = np.maximum(w * ((x / (w @ h)) @ h.T) / h.sum(1), 1.19e-7)
            h = h * (w.T @ (x / (w @ h))) / w.sum(0)[:, None]
        y = w @ h
        if (cost := (np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / y), 0) - x + y).sum()) < best:
            best, want = cost, (w * h.sum(1), h / h.sum(1, keepdims=True))
    w, h = want
    order = np.argsort(-w.sum(0))
    dt, tw = X.topics(b, 3, iterations=30, starts=2)
    assert dt.count() == 180
    assert all(np.isclose(r["weight"], w[int(r["doc"][1:]), order[r["topic"] - 1]], rtol=1e-5) for r in dt.collect())
    assert all(np.isclose(r["weight"], h[order[r["topic"] - 1], int(r["word"][1:])], atol=1e-7) for r in tw.collect())
