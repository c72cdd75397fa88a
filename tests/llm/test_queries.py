"""The corpus queries that have SQL, compared with DuckDB on the small tables."""

import duckdb
import pytest

from compare import TABLES, canonical
from inkspect.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(llm.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = llm.queries()[name](spark, sf)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.collect(), df.columns) == canonical(cursor.fetchall(), columns)
