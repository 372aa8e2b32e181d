import math

from pyspark.sql import functions as F

from polyad.operators import text as X

SCHEMA = "doc_id string, text string, word string"


def docs(spark, **t):
    return spark.createDataFrame([(k, v, "clash") for k, v in t.items()], SCHEMA)


def test_bag_and_idf(spark):
    c = X.word_counts(X.token_table(docs(spark, a="salt and soup", b="soup and stars", c=None, d="")))
    assert c.count() == 6
    w = {(r["doc"], r["word"]): r["weight"] for r in X.bag(c, "tfidf").collect()}
    assert math.isclose(w["a", "soup"], 1) and math.isclose(w["a", "salt"], math.log(3 / 2) + 1)


def test_tokens(spark):
    d = docs(spark, a="Don’t 'quote' ÉTÉ, x2y")
    assert [r["word"] for r in X.token_table(d).orderBy("pos").collect()] == ["don't", "quote", "été", "x", "y"]


def test_windows(spark):
    w = X.token_table(docs(spark, a="b a", c="x y z x y"))
    _, e = X.text_windows(w, 3)
    assert {r["edge"]: r["edge_weight"] for r in e.collect()} == {"a | b": 1.0, "x | y | z": 3.0}
    _, t = X.text_windows(w, 3, tumbling=True)
    assert {r["edge"]: r["edge_weight"] for r in t.collect()} == {"a | b": 1.0, "x | y | z": 1.0, "x | y": 1.0}


def test_clean(spark):
    d = docs(spark, a="<p>See <b>this</b> &amp; that</p> https://x.y/z [3, 4] (Doe et al. 2001)", b=None, c="12 34 a")
    r = {x["doc_id"]: x["t"] for x in d.select("doc_id", X.clean(F.col("text"), min_content=0.5).alias("t")).collect()}
    assert r == {"a": "See this & that", "b": None, "c": ""}


def test_topics_split_planted_blocks(spark):
    d = docs(spark, **{f"d{i}": ("soup salt pot " if i % 2 else "star moon sky ") * 5 for i in range(8)})
    dt, _ = X.topics(X.bag(X.word_counts(X.token_table(d))), 2, iterations=60)
    best = {r["doc"]: r["t"] for r in dt.groupBy("doc").agg(F.max_by("topic", "weight").alias("t")).collect()}
    assert len({best[f"d{i}"] for i in range(0, 8, 2)}) == 1 and best["d0"] != best["d1"]


def test_frontier_of_any_number_of_rows(spark):
    rows = [(i, i % 97, float(i * 7919 % 10_007)) for i in range(10_050)] + [(20_000, 200, None), (20_001, 96, 10_006.0), (20_002, 96, 10_006.0)]
    top, best = {}, None
    for a in sorted({r[1] for r in rows if r[2] is not None}, reverse=True):
        high = max(r[2] for r in rows if r[1] == a and r[2] is not None)
        if best is None or high > best:
            top[a], best = high, high
    got = {r["i"] for r in X.dominant(spark.createDataFrame(rows, "i int, a int, b double"), ["a", "b"]).where("frontier").collect()}
    assert got == {i for i, a, b in rows if b is None or top.get(a) == b}


def test_frontier_is_thinned_by_blocks(spark, monkeypatch):
    seen = []
    rivals = X._rivals
    monkeypatch.setattr(X, "_rivals", lambda rows, *a: seen.append(rows.count()) or rivals(rows, *a))
    s = spark.range(60_000).selectExpr("id", "cast(id % 251 as int) a", "cast((id * 7919) % 60013 as double) b", "cast(1 as int) c")
    got = {r["id"] for r in X.dominant(s, ["a", "b", "c"]).where("frontier").collect()}
    best, want = -1.0, set()
    for r in sorted(s.collect(), key=lambda r: (-r["a"], -r["b"])):
        if r["b"] > best:
            best = r["b"]
            want.add(r["id"])
    assert got == want and seen[-1] < 10_000


def test_frontier_on_which_all_rows_stand(spark):
    s = spark.range(2_500).selectExpr("id a", "-id b")
    assert X.dominant(s, ["a", "b"]).where("frontier").count() == 2_500
