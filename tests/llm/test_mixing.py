from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from polyad.llm.mixing import mix_sources, sainte_lague

DOCS = "doc_id long, source string, text string, copies int"
TARGETS = "source string, target_share double, max_repeats int, note string"


def test_sainte_lague():
    assert sainte_lague([53, 24, 23], 7, [99] * 3) == [3, 2, 2]
    assert sainte_lague([1, 1], 5, [1, 9]) == [1, 4] and sainte_lague([1], 5, [2]) == [2] and sainte_lague([], 3, []) == []


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 120))
def test_sainte_lague_is_that_of_single_seats(parties, seats):
    w, caps = [float(a) for a, _ in parties], [c for _, c in parties]
    got = [0] * len(w)
    for _ in range(seats):
        open_ = [i for i in range(len(w)) if w[i] and got[i] < caps[i]]
        if open_:
            got[min(open_, key=lambda i: (-Fraction(w[i]) / (2 * got[i] + 1), i))] += 1
    assert sainte_lague(w, seats, caps) == got


@pytest.mark.parametrize("seed", [42, 1, 2, 3, 4])
def test_long_texts_shift_no_share(spark, seed):
    """A hundredth of the documents holds most of the tokens."""
    rows = [(i, "ab"[i % 2], None, 0) for i in range(6000)]
    sizes = spark.createDataFrame([(i, 40_000 if i % 100 == 0 else 5 + i % 90) for i in range(6000)], "doc_id long, n_tokens long")
    t = spark.createDataFrame([("a", 0.3, 2, ""), ("b", 0.7, 3, "")], TARGETS)
    s = {r["source"]: r for r in mix_sources(spark.createDataFrame(rows, DOCS), t, seed=seed, sizes=sizes).shares().collect()}
    assert abs(s["a"]["actual_share"] - 0.3) < 0.01 and s["a"]["most_copies"] <= 2 and s["b"]["most_copies"] <= 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "Big " if i % 2 else "big", "word " * (5 + i % 7), 0) for i in range(1500)]
    rows += [(10_000 + i, "small", "word " * 8, 0) for i in range(120)] + [(20_000 + i, "other", "word " * 8, 0) for i in range(50)]
    rows += [(30_000, "big", None, 0), (30_001, "big", "", 0), (30_002, None, "word", 0), (None, "big", "word", 0), (0, "big", "word word word word word", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_repeats(spark, docs):
    t = spark.createDataFrame([("big", 0.6, 1, ""), (" SMALL", 0.4, 3, ""), ("absent", 0.0, 5, ""), ("none", 0.0, 2, "")], TARGETS)
    m = mix_sources(docs, t)
    used = m.documents().collect()
    top = {}
    for r in used:
        top[r["source"]] = max(top.get(r["source"], 0), r["copies"])
    assert set(top) == {"big", "small"} and top["big"] <= 1 and top["small"] <= 3
    assert len({r["doc_id"] for r in used}) == len(used)
    s = {r["source"]: r for r in m.shares().collect()}
    assert abs(s["big"]["actual_share"] - 0.6) < 0.005 and s["absent"]["mixed_tokens"] == 0
    assert sum(r["n_tokens"] * r["copies"] for r in used) == sum(x["mixed_tokens"] for x in s.values())
    assert sorted(map(tuple, mix_sources(docs, t).documents().collect())) == sorted(map(tuple, used))


def test_caps_bind_and_empty(spark, docs):
    t = spark.createDataFrame([("big", 0.5, 1, ""), ("small", 0.5, 2, ""), (None, 0.1, 1, "")], TARGETS)
    s = {r["source"]: r for r in mix_sources(docs, t, total_tokens=10**9).shares().collect()}
    assert s["small"]["most_copies"] <= 2 and s["big"]["most_copies"] <= 1
    assert s["small"]["mixed_tokens"] == 2 * s["small"]["available_tokens"]
    assert mix_sources(docs.limit(0), t).documents().count() == 0
    assert mix_sources(docs, t.limit(0)).shares().count() == 0
