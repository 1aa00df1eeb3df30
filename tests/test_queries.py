"""Every query with SQL against DuckDB on the same tables, as the driver compares them."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "is_finite"):
        return round(float(v), 6)
    return v if v is None or isinstance(v, int | bool | str) else str(v)[:19]


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in SQL and n[0] in "AXPCFJTWU"))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
