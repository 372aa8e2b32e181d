import random

import pytest
from pyspark.sql import functions as F

from polyad.llm.runs import collapse_runs, resolve_code

SCHEMA = "message_id long, session_id string, timestamp long, code string, n_events int"
BOOK = [("Set_Goal", "SG"), ("Accept_Draft", "ACD"), ("Accept_Part", "ACP"), ("Verify_Input", "VFI")]


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame(BOOK, "code string, short string")


@pytest.mark.parametrize(("written", "code"), [
    ("set goal", "Set_Goal"), ("SetGoal", "Set_Goal"), ("Ｓｅｔ_Ｇｏａｌ", "Set_Goal"), ("Sét_Goal.", "Set_Goal"), ("human:set_goal", "Set_Goal"), ("> set_goal", "Set_Goal"), ("Set_Goal (2)", "Set_Goal"),
    ("Set_Goal x3", "Set_Goal"), ("Set_Goal [retry]", "Set_Goal"), ("sg", "Set_Goal"), ("Acept_Draft", "Accept_Draft"), ("Accept_rDaft", "Accept_Draft"), ("acp", "Accept_Part"), ("Set–Goal", "Set_Goal"),
    ("n/a", None), ("-", None), ("  ", None), (None, None), ("Something_Else", None), ("sgg", None),
])
def test_codes(spark, book, written, code):
    df = spark.createDataFrame([(written,)], "c string")
    assert df.select(resolve_code(F.col("c"), book)).first()[0] == code


def brute(rows, names):
    one = {}
    for i, k, t, c, _ in rows:
        if None in (i, k, t):
            continue
        t = t // 1000 if t > 10**11 else t
        key = (k, t, (c is not None, c or ""))
        if i not in one or key < one[i]:
            one[i] = key
    by = {}
    for i, (k, t, c) in one.items():
        by.setdefault(k, []).append((t, i, names.get(c[1]) if c[0] else None))
    out = set()
    for k, xs in by.items():
        run = []
        for x in [*sorted(xs, key=lambda x: x[:2]), (0, 0, object())]:
            if run and x[2] != run[-1][2]:
                if run[0][2]:
                    out.add((k, run[0][2], len(run), run[0][1], run[-1][1], run[-1][0] - run[0][0]))
                run = []
            run.append(x)
    return out


def rows_of(seed, n=1200):
    rnd = random.Random(seed)
    names = {"Set_Goal": "Set_Goal", "set goal": "Set_Goal", "ACD": "Accept_Draft", "Accept_Draft": "Accept_Draft"}
    rows = []
    for i in range(n):
        t = rnd.randrange(1_700_000_000, 1_700_000_400)
        rows.append((i, "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None]), rnd.choice([t, t, t, t * 1000 + 7, None]), rnd.choice([*names, "Set_Goal", "n/a", None]), 0))
    return rows + rows[:50], names


@pytest.mark.parametrize("floor", [10**9, 50])
def test_against_brute_force(spark, book, floor):
    rows, names = rows_of(floor)
    r = collapse_runs(spark.createDataFrame(rows, SCHEMA), "session_id", "timestamp", "message_id", "code", book, rows_per_task=floor).collect()
    assert {(x["session_id"], x["code"], x["n_events"], x["first_id"], x["last_id"], x["duration_s"]) for x in r} == brute(rows, names)


def test_empty(spark, book):
    df = spark.createDataFrame([], SCHEMA)
    assert collapse_runs(df, "session_id", "timestamp", "message_id", "code", book).count() == 0
    assert collapse_runs(df, "session_id", "timestamp", "message_id", "code").count() == 0
