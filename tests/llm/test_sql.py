"""Queries against their SQL in an independent engine, and that engine's fingerprints against the library's hash."""

import os

import duckdb
import pytest

from tidemark.llm import queries, simhash, simhash_sql
from tests.llm.test_simhash import brute_classes

DIR = "/root/testdata/sf0.001"


def engine(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}')")
    return con


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, DIR)
    result = engine(DIR).sql(queries.oracle_sql()[name])
    assert sorted(result.columns) == sorted(df.columns)
    at = [df.columns.index(c) for c in result.columns]
    rows = [tuple(r) for r in df.collect()]
    assert rows and plain([tuple(r[i] for i in at) for r in rows]) == plain(result.fetchall())


def test_fingerprints_of_shingles_of_all_lengths(spark, tmp_path):
    texts = [None, "", " \t\n", "é𝄞 É a B"] + ["x" * n for n in range(1, 140)] + [f"{'a' * (n // 2)} B{'é' * (n % 7)} {'c' * (n // 3)} d e" for n in range(120)] + ["a b c d " * 40, "A\x0bB\x0cC  D E"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    rows = engine(str(tmp_path)).sql(simhash_sql.sql()).fetchall()
    prints = {i: simhash.fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(f, 16) for i, f, _ in rows} == prints
    assert {i: c for i, _, c in rows} == brute_classes(prints)
