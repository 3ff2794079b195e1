"""Every query with SQL gives the same rows as the SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from catalog.views import TABLES
from tools.check_queries import rows_of

QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "ratio" in df.columns
