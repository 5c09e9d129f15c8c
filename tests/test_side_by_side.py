"""Every registered query against its SQL in DuckDB on the same tables."""
import os

import duckdb
import pytest

from leafmill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES = registry.queries()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES.split():
        con.sql(f"create view {name} as select * from '{os.path.join(sf_dir, name)}.parquet'")
    return con


def normal(v):
    return round(v, 6) if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=str)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"src_1_table_files"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == rows(rel.columns, rel.fetchall())
