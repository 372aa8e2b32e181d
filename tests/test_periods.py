import datetime as dt
import random

from polyad.operators.periods import periods_and_gaps

T0 = dt.datetime(2020, 1, 1)
SCHEMA = "actor string, group string, start timestamp, end timestamp, kind string"
D = lambda n: T0 + dt.timedelta(days=n)


def brute(rows, until):
    by = {}
    for a, g, s, e, _ in rows:
        if None in (a, g, s) or (e is not None and e < s):
            continue
        e = min(e or until, until)
        if e >= s:
            by.setdefault((a, g), []).append((s, e))
    out = set()
    for k, xs in by.items():
        merged = []
        for s, e in sorted(xs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(*k, "period", s, e) for s, e in merged}
        out |= {(*k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)}
    return out


def found(df):
    return {(r["actor"], r["group"], r["kind"], r["start"], r["end"]) for r in df.collect()}


def rows_of(seed, n=1500):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        a = "hot" if rnd.random() < 0.5 else rnd.choice([None, "a", "b"])
        s = None if rnd.random() < 0.02 else D(rnd.randrange(0, 4000))
        e = None if rnd.random() < 0.01 else (s or T0) + dt.timedelta(days=rnd.choice([-1, 0, 0, 1, 2, 3]))
        rows.append((a, rnd.choice(["g", None]) if a != "hot" else "g", s, e, "x"))
    return rows + rows[:40]


def test_against_brute_force(spark):
    rows = rows_of(1)
    got = periods_and_gaps(spark.createDataFrame(rows, SCHEMA), ["actor", "group"], observed_until="2030-01-01 00:00:00")
    assert found(got) == brute(rows, dt.datetime(2030, 1, 1))


def test_hot_keys_are_cut_without_loss(spark):
    rows = [r for r in rows_of(2) if r[3] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    got = periods_and_gaps(df, ["actor", "group"], observed_until="2030-01-01 00:00:00", rows_per_task=100)
    assert found(got) == brute(rows, dt.datetime(2030, 1, 1))


def test_touching_nested_open_and_empty(spark):
    rows = [("a", "g", D(0), D(2), ""), ("a", "g", D(2), D(3), ""), ("a", "g", D(1), D(2), ""), ("a", "g", D(9), None, ""), ("a", "g", D(5), D(5), ""), ("a", "g", D(50), D(60), "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(periods_and_gaps(df, ["actor", "group"], observed_until="2020-01-21 00:00:00"))
    k = ("a", "g")
    assert got == {(*k, "period", D(0), D(3)), (*k, "gap", D(3), D(5)), (*k, "period", D(5), D(5)), (*k, "gap", D(5), D(9)), (*k, "period", D(9), D(20))}
    assert periods_and_gaps(df.limit(0), ["actor", "group"]).count() == 0
