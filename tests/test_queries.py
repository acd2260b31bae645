"""Every catalogue query against DuckDB on the same tables."""

import math

import duckdb
import pytest

from catalume.catalog import TABLES
from catalume import review_queries, text_queries  # noqa: F401  they add their queries
from catalume.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if x is None:
        return "\0null"
    if isinstance(x, float) and math.isnan(x):
        return "\0nan"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return repr(round(float(x), 9))
    return str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    wanted = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    found = QUERIES[name](spark, FOLDER)
    assert len(found.collect()) > 0 and found.columns


def test_entry_module(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
