import random

import pytest

from polyad.llm import tokens as T

ODD = ["", " ", None, "a<|endoftext|>b", "naïve été — ½ 😀👩🏽‍🏫", "  two  spaces\t\n\r\n x", "it's we'll 'RE", "\x00\x1c  x", "1234567890" * 3]


def direct(text):
    return T.encode_text(text)


def test_every_kind_of_text_once_a_row(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate([*ODD, ODD[4]])], "doc_id long, text string, ids int")
    got = {r["doc_id"]: list(r["ids"]) for r in T.encode(df).collect()}
    assert got == {i: direct(t) for i, t in enumerate([*ODD, ODD[4]])}
    assert got[0] == [] and got[2] == [] and 50256 not in got[3]
    assert T.encode(df.limit(0)).count() == 0
    again = {r["doc_id"]: r["text"] for r in T.decode(T.encode(df)).collect()}
    assert again == {i: (t or "") for i, t in enumerate([*ODD, ODD[4]])}


@pytest.mark.parametrize("seed", range(3))
def test_long_texts_are_stitched_exactly(spark, seed):
    rnd = random.Random(seed)
    alphabet = ["word", "été", " ", "  ", "\n", "\n\n", "12", "'s", "'", "!?", "…", "日本", "x" * 30, " " * 20]
    texts = ["".join(rnd.choice(alphabet) for _ in range(600)) for _ in range(6)]
    texts += ["y" * 5000, " " * 3000 + "end", "ab " * 700 + "z" * 2000 + " tail"]  # runs without a break
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = df.unionByName(df.where("doc_id = 0"))
    rows = T.encode(df, chunk=200, overlap=50).collect()
    assert len(rows) == len(texts) + 1 and all(list(r["ids"]) == direct(texts[r["doc_id"]]) for r in rows)
    counts = {r["doc_id"]: r["n_tokens"] for r in T.encode(df, count_only=True, chunk=200, overlap=50).collect()}
    assert counts == {i: len(direct(t)) for i, t in enumerate(texts)}


def test_scripts_without_blanks_are_parted_too(spark):
    rnd = random.Random(8)
    text = "".join(rnd.choice(["日本語", "这是一个句子", "かな", "カタカナ", "。", "、", "！？", "２３"]) for _ in range(4000))
    assert len(T.boundaries(text)) > 200
    df = spark.createDataFrame([(1, text), (2, "字" * 3000)], "doc_id long, text string")
    assert {r["doc_id"]: list(r["ids"]) for r in T.encode(df, chunk=400, overlap=100).collect()} == {1: direct(text), 2: direct("字" * 3000)}


def test_a_run_the_fast_encoder_cannot_take():
    assert len(direct(" " * 400_000)) == 400_000
