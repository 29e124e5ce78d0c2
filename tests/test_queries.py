"""Every registered query against its SQL on the smallest scale."""

import pathlib
import sys

import duckdb
import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import TABLES, kind, rows_of  # noqa: E402
from tidemark.workload import QUERIES, SQL  # noqa: E402

SF = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    """Of the series library; corpus queries that SQL can't express are tested in their own folder."""
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["l_returnflag", "time", "l_quantity", "l_extendedprice", "l_discount"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, str(SF))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert got == want
    if got:
        assert [kind(v) for v in got[0]] == [kind(v) for v in want[0]]
