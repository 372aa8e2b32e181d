import datetime as dt
import random

import pytest

from polyad.errors import MissingColumn
from polyad.operators.sessions import entity_of, sessionize

T0 = dt.datetime(2025, 3, 1)
SCHEMA = "event_id long, entity string, timestamp timestamp, received_at timestamp, first_us string"


def brute(rows, gap=900):
    best = {}
    for i, e, t, got, *_ in rows:
        if None in (i, e, t):
            continue
        k = (got is not None, got or T0, t, e)
        if i not in best or k < best[i][0]:
            best[i] = (k, e, t)
    out, runs = set(), {}
    for i, (_, e, t) in best.items():
        runs.setdefault(e, []).append((t, i))
    for e, xs in runs.items():
        xs.sort()
        cur = [xs[0]]
        for x in xs[1:]:
            if (x[0] - cur[-1][0]) > dt.timedelta(seconds=gap):
                out.add((e, cur[0][1], cur[-1][1], len(cur)))
                cur = []
            cur.append(x)
        out.add((e, cur[0][1], cur[-1][1], len(cur)))
    return out


def found(df):
    return {(r["entity"], r["first_event_id"], r["last_event_id"], r["n_events"]) for r in df.collect()}


def test_against_brute_force_with_a_hot_entity(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(3000):
        e = "hot" if rnd.random() < 0.4 else rnd.choice([None, "a", "b", "c"])
        t = None if rnd.random() < 0.02 else T0 + dt.timedelta(seconds=rnd.randrange(0, 400_000), microseconds=rnd.choice([0, 0, 1]))
        rows.append((i, e, t, T0 + dt.timedelta(days=rnd.randrange(9)), "x"))
        if rnd.random() < 0.1:
            rows.append((i, e, t, T0 + dt.timedelta(days=20), "x"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(sessionize(df, received="received_at")) == brute(rows)


def test_gap_is_exact_to_the_microsecond(spark):
    at = [T0, T0 + dt.timedelta(seconds=900), T0 + dt.timedelta(seconds=1800, microseconds=1)]
    df = spark.createDataFrame([(i, "a", t, None, "x") for i, t in enumerate(at)], SCHEMA)
    assert found(sessionize(df)) == {("a", 0, 1, 2), ("a", 2, 2, 1)}


def test_ties_empty_and_missing(spark):
    df = spark.createDataFrame([(5, "a", T0, None, "x"), (3, "a", T0, None, "x")], SCHEMA)
    r = sessionize(df).collect()
    assert [(x["first_event_id"], x["last_event_id"], x["duration_s"]) for x in r] == [(3, 5, 0.0)]
    assert sessionize(df.limit(0)).count() == 0
    with pytest.raises(MissingColumn):
        sessionize(df, "nope")


def test_entity(spark):
    df = spark.createDataFrame([(" U-1\t", "d"), ("  ", "d"), (None, "d"), (None, None)], "u string, d string")
    assert [r[0] for r in df.select(entity_of("u", "d")).collect()] == ["u-1", "d", "d", None]
