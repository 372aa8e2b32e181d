import numpy as np
import pytest

from polyad.errors import LongFormat, NotErgodic
from polyad.operators import sequences as Q


def seqs(spark, *texts):
    rows = [(str(i), p + 1, s) for i, t in enumerate(texts) for p, s in enumerate(t)]
    return spark.createDataFrame(rows, "seq_id string, pos int, state string")


def test_kgrams_stop_at_gaps_and_ends(spark):
    s = spark.createDataFrame([("1", 1, "a"), ("1", 2, None), ("1", 3, "b"), ("1", 4, "c")], "seq_id string, pos int, state string")
    got = {(tuple(r["context"]), r["target"], r["count"]) for r in Q.kgrams(s, 2).collect()}
    assert got == {(("b",), "c", 1)}


def test_rules_find_planted_memory(spark):
    s = seqs(spark, *["abc" * 5] * 8, *["xbd" * 5] * 8)
    r = Q.memory_rules(s, 3).where("order > 1").collect()
    assert {tuple(x["context"]) for x in r} == {("a", "b"), ("x", "b")}
    assert all(x["probability"] == 1 for x in r)


def test_rules_are_first_order_without_memory(spark):
    assert {r["order"] for r in Q.memory_rules(seqs(spark, "abab", "abab"), 3).collect()} == {1}


def test_first_passage_closed_form():
    p = np.array([[0.7, 0.2, 0.1], [0.3, 0.5, 0.2], [0.2, 0.3, 0.5]])
    r = Q.chain_stability(p)
    assert np.allclose(r["stationary"], np.array([19, 13, 9]) / 41)
    assert np.allclose(r["first_passage"], [[41 / 19, 60 / 13, 70 / 9], [70 / 19, 41 / 13, 20 / 3], [80 / 19, 50 / 13, 41 / 9]])
    assert np.allclose(r["sojourn"], [10 / 3, 2, 2])
    with pytest.raises(NotErgodic):
        Q.chain_stability(np.eye(2))


def test_bootstrap_hand_count(spark):
    r = {(x["context"], x["target"]): x for x in Q.bootstrap(seqs(spark, "abac", "abab"), n_boot=40).collect()}
    assert r[("a", "b")]["probability"] == 0.75 and r[("a", "c")]["probability"] == 0.25
    assert all(0 <= x["lower"] <= x["upper"] <= 1 for x in r.values())


def test_wide_and_collapse(spark):
    w = spark.createDataFrame([("1", "a", None, "b", None), ("2", "a", "a", "a", None)], "id string, T1 string, T2 string, T3 string, T4 string")
    s = Q.from_wide(w, "id", ["T1", "T2", "T3", "T4"])
    assert [(r["pos"], r["state"]) for r in s.where("seq_id = '1'").orderBy("pos").collect()] == [(1, "a"), (2, None), (3, "b")]
    assert Q.collapse_repeats(s).where("seq_id = '2'").count() == 0
    with pytest.raises(LongFormat):
        Q.from_wide(w.withColumnRenamed("T1", "time").withColumnRenamed("T2", "session"), "id", ["T3"])


def test_permutation_of_groups(spark):
    s = seqs(spark, *["abab"] * 6, *["acac"] * 6)
    g = spark.createDataFrame([(str(i), "x" if i < 6 else "y") for i in range(12)], "seq_id string, grp string")
    r = {(x["context"], x["target"]): x for x in Q.compare_groups(s, g, n_perm=60).collect()}
    assert r[("a", "b")]["difference"] == 1 and r[("a", "b")]["p_value"] < 0.1
