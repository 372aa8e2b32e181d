import pytest

from polyad.errors import BadInput, UnparsedTime
from polyad.operators import temporal as T
from polyad.operators.hypergraph import Hypergraph
from polyad.sources.hif import read_hif, write_hif


def spells(spark, rows):
    df = spark.createDataFrame(rows, "actor string, group string, s string, e string").selectExpr("actor", "group", "timestamp(s) as start", "timestamp(e) as end")
    return T.spells(df, "actor", "group", "start", "end")


def test_interval_snapshots(spark):
    s = spells(spark, [("a", "A", "2020-01-01", "2020-01-03"), ("b", "A", "2020-01-01", "2020-01-03"), ("b", "B", "2020-01-02", "2020-01-02")])
    t = T.grid(spark, "2020-01-01", "2020-01-04", "1 day")
    g = [(r["edges"], r["cum_edges"], r["nodes"]) for r in T.growth(s, t).orderBy("t").collect()]
    assert g == [(1, 1, 2), (2, 2, 2), (1, 2, 2), (0, 2, 0)]


def test_open_and_reversed_spells(spark):
    s = spells(spark, [("a", "A", "2020-01-01", None)])
    assert T.snapshots(s, T.grid(spark, "2030-01-01", "2030-01-01", "1 day")).count() == 1
    with pytest.raises(BadInput):
        spells(spark, [("a", "A", "2020-01-02", "2020-01-01")])


def test_contacts(spark):
    df = spark.createDataFrame([("ab"[i // 3], f"e{i}", i) for i in (1, 2, 3)], "actor string, group string, t int").selectExpr("actor", "group", "timestamp_seconds(t) as t")
    s = T.spells(df, "actor", "group", "t")
    at = spark.sql("select timestamp_seconds(2) t")
    assert T.active(s, at, contacts=True).count() == 1 and T.active(s, at, "cumulative").count() == 2


def test_roles_and_formats(spark):
    df = spark.createDataFrame([("x", "31.12.2020"), ("y", "01.02.2021"), (None, "?")], "User_ string, Date string")
    assert T.find_roles(df) == {"time": "Date", "actor": "User_"}
    assert T.parse_times(df, "Date").where("Date is not null").count() == 2
    with pytest.raises(UnparsedTime):
        T.parse_times(df, "User_")


def test_hif_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("a", "e", 1.0), ("b", "e", 2.5)], "node string, edge string, weight double")
    p = str(tmp_path / "g.json")
    write_hif(Hypergraph(m), p)
    assert sorted(map(tuple, read_hif(spark, p).memberships.collect())) == [("a", "e", 1.0), ("b", "e", 2.5)]
    (tmp_path / "d.json").write_text('{"network-type": "directed", "incidences": []}')
    with pytest.raises(BadInput):
        read_hif(spark, str(tmp_path / "d.json"))
