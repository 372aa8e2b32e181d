from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_does_not_import_the_training_data_subpackage():
    own = [p for p in (ROOT / "polyad").rglob("*.py") if "llm" not in p.parts]
    assert own and not [p for p in own if "polyad.llm" in p.read_text()]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["p2_sessions", "p3_found", "kgram_counts", "node_measures"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = entry.queries()[name](spark, str(DATA))
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(f'"{c}"' for c in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want)) and want
