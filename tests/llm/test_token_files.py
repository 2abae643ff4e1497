import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import queries, token_files
from tidemark.llm.elias_fano import EliasFano
from tidemark.llm.tokens import public_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=2000) | st.lists(st.integers(0, 50), max_size=2000))
def test_elias_fano_round_trip(values):
    values = np.array(sorted(values), np.int64)
    coded = EliasFano.from_bytes(EliasFano.build(values).to_bytes())
    assert coded.range(0, len(values)).tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert coded.select(i) == values[i]
        assert coded.range(i, min(i + 5, len(values))).tolist() == values[i : i + 5].tolist()


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.default_rng(0).integers(1, 1000, 100_000))
    assert len(EliasFano.build(bounds).to_bytes()) * 8 / len(bounds) < 12


def expected(docs):
    t = Tokenizer.from_file(public_path(token_files.TOKENIZER))
    at, out = 0, []
    for doc_id, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip_of_odd_rows(spark, tmp_path):
    docs = [(5, None), (4, ""), (None, None), (3, "b"), (-7, "é𝄞 <|endoftext|>\n\n x"), (2**62, "w " * 60_000)] + [(i, f"doc {i}" * (i % 9)) for i in range(10, 400)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, start string").repartition(3)
    manifest = token_files.write(df, f"file://{tmp_path}/t", shards=5)
    got = sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_files.read(spark, f"file://{tmp_path}/t", manifest).collect())
    assert [(d, s, n, c) for s, d, n, c in got] == expected(docs)
    reader = token_files.Reader(f"{tmp_path}/t", "shard-000000.tok")
    assert sum(len(reader.document(i)) for i in range(reader.n)) == reader.ids
    torn = (tmp_path / "t/shard-000000.tok").read_bytes()[:-3]
    (tmp_path / "t/shard-000000.tok").write_bytes(torn)
    with pytest.raises(ValueError):
        token_files.Reader(f"{tmp_path}/t", "shard-000000.tok")


def test_repeated_and_null_ids_are_spread_and_agree(spark, tmp_path):
    docs = [(None, f"text {i % 7}") for i in range(300)] + [(1, "same")] * 300 + [(2, f"x{i}") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    read = lambda: spark.read.parquet(str(tmp_path / "d"))
    runs = []
    for k in range(2):
        manifest = token_files.write(read(), f"file://{tmp_path}/t{k}", shards=6)
        assert len(manifest) == 6 and max(n for _, n, _ in manifest) < 250
        runs.append(sorted((r.start, r.doc_id, bytes(r.ids)) for r in token_files.read(spark, f"file://{tmp_path}/t{k}", manifest).collect()))
    t = Tokenizer.from_file(public_path(token_files.TOKENIZER))
    assert runs[0] == runs[1] and [r[1] for r in runs[0]] == [None] * 300 + [1] * 300 + [2] * 30
    assert Counter((r[1], r[2]) for r in runs[0]) == Counter((d, np.array([*t.encode(x).ids, 2], "<u4").tobytes()) for d, x in docs)


def test_elias_fano_over_many_chunks():
    values = np.sort(np.random.default_rng(1).integers(-(2**40), 2**40, 30_000))
    coded = EliasFano.from_bytes(EliasFano.build(values).to_bytes())
    assert (coded.range(0, 30_000) == values).all() and coded.select(29_999) == values[-1] and coded.range(8190, 8195).tolist() == values[8190:8195].tolist()


def test_empty_table(spark, tmp_path):
    manifest = token_files.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/t")
    assert manifest == [] and token_files.read(spark, f"file://{tmp_path}/t", manifest).count() == 0


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_token_files(spark, sf_dir).collect()) == sorted(expected(docs))
