import duckdb
import pytest

import __spark_entry__ as entry
from check import table
from shelfmark.workload.registry import TABLES


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, db, small, name):
    df = entry.queries()[name](spark, small)
    got = table(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    result = db.execute(sql)
    assert got == table([c[0] for c in result.description], result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["folder", "seq", "name"]
