"""Every registered key-value query against the independent engine on the same files."""

import os

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def _plain(rows):
    return sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    assert sql is not None
    result = duck.sql(sql)
    columns = result.columns
    assert sorted(columns) == sorted(df.columns)
    at = [df.columns.index(c) for c in columns]
    assert _plain([tuple(r[i] for i in at) for r in rows]) == _plain(result.fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
