import functools
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, queries, tokens
from tidemark.llm.tokens import Encoder, public_path

ODD = [None, "", "  a\n\n b", "<|endoftext|> x<|startoftext|>", "don't  'S 12345 \t tab\n", "éÉ ﬁ ̈a", "日本語 テスト", "a\x1cb \x85 c", "   ", "\n", "x" * 5000, "a  \x85b", "a <|endoftext|> b", " \n<|endoftext|>\n <|STARTOFTEXT|><|startoftext|>", "Σας ΣΑΣ İ", "hello, world. " * 4000, "A.B!? c's"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(spark, sf_dir, name):
    encoder, tokenizer = Encoder(name), Tokenizer.from_file(public_path(name))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD
    for t in texts:
        assert np.frombuffer(encoder.ids(t), encoder.dtype).tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
    plain = Encoder(name, plain_specials=True)
    tokenizer.encode_special_tokens = True
    for t in ODD:
        assert np.frombuffer(plain.ids(t), plain.dtype).tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_generations_of_kept_pieces(monkeypatch, name):
    monkeypatch.setattr(tokens, "KEPT_BYTES", 3000)
    encoder, tokenizer, rng = Encoder(name), Tokenizer.from_file(public_path(name)), np.random.default_rng(0)
    for _ in range(60):
        t = " ".join("".join(rng.choice(list("abcde,.!"), 4)) for _ in range(40))
        assert np.frombuffer(encoder.ids(t), encoder.dtype).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        assert encoder.plain.held < 4000 and encoder.spaced.held < 3000


def check(rows, docs, limits):
    """Every id once, no gaps, limits held; returns the share of padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for d, ids in docs.items():
        ps = sorted(by_doc[d], key=lambda r: r.start)
        assert [r.start for r in ps] == [0, *np.cumsum([r.length for r in ps])[:-1]]
        assert b"".join(bytes(r.ids) for r in ps) == np.array(ids, "<u4").tobytes() and {r.doc_tokens for r in ps} == {len(ids)}
    pad = 0
    for ps in by_seq.values():
        ps.sort(key=lambda r: r.offset)
        assert [r.offset for r in ps] == [0, *np.cumsum([r.length for r in ps])[:-1]]
        n = sum(r.length for r in ps)
        assert 0 < n <= limits.tokens and len(ps) <= limits.segments and sum(r.loss_tokens for r in ps) <= limits.loss
        pad += 0 if n & (n - 1) == 0 else limits.tokens - n
    return pad / sum(len(x) for x in docs.values())


@functools.cache
def library():
    return Tokenizer.from_file(public_path(packing.TOKENIZER))


def ids_of(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 2]


def test_pack_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, offset int").repartition(2)
    assert check(packing.pack(docs).collect(), {i: ids_of(t) for i, t in enumerate(ODD)}, packing.Limits()) == 0
    assert packing.pack(docs.limit(0)).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and sum(r.length for r in rows) == 5


def test_prompts_bear_no_loss_and_limits_hold(spark):
    rows = [(i, "question " * (i % 50), "answer " * (1 + i * 37 % 400)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    limits = packing.Limits(1024, 6, 500)
    got = packing.pack(docs, limits=limits).collect()
    want = {i: ids_of(p)[:-1] + ids_of(t) for i, p, t in rows}
    assert check(got, want, limits) == 0
    assert sum(r.loss_tokens for r in got) == sum(len(ids_of(t)) for _, _, t in rows)


def test_pool_keeps_nothing_back():
    packer, rng, out = packing.Packer(packing.Limits(), pool_tokens=20_000), np.random.default_rng(1), []
    sizes = rng.integers(1, 9000, 200).tolist()
    for i, n in enumerate(sizes):
        out += packer.add(i, np.zeros(n, np.uint16))
        assert packer.waiting <= 20_000
    out += packer.finish()
    assert sum(b - a for s in out for _, a, b in s) == sum(sizes)


def test_pool_is_bounded_in_documents_and_short_ones_pack_in_linear_time():
    packer, out, one = packing.Packer(packing.Limits(segments=4096)), 0, np.zeros(1, np.uint16)
    began = time.process_time()
    for i in range(300_000):
        for s in packer.add(i, one):
            assert len(s) == 4096
            out += len(s)
        assert packer.docs <= packing.POOL_DOCS
    out += sum(len(s) for s in packer.finish())
    assert out == 300_000 and time.process_time() - began < 30  # 3 s; with a scan of all that wait it would be minutes


def test_null_and_empty_texts_in_one_task(spark):
    rows = spark.range(0, 60_000, 1, 1).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "if(id % 2 = 0, null, '') AS text")
    got = packing.pack(rows).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).collect()
    limit = packing.Limits().segments
    assert sum(r.n for r in got) == 60_000 and all(r.pieces <= limit and r.n & (r.n - 1) == 0 for r in got)


def test_each_limit_binds_and_the_largest_product_goes_first():
    def packed(sizes, limits):
        packer = packing.Packer(limits)
        out = [s for i, (n, p) in enumerate(sizes) for s in packer.add(i, np.zeros(n, np.uint16), p)]
        return out + list(packer.finish())

    by_segments = packed([(1, 0)] * 40, packing.Limits(4096, 8, 4096))
    assert [len(s) for s in by_segments] == [8] * 5
    by_loss = packed([(64, 0)] * 8, packing.Limits(256, 8, 128))
    assert [[b - a for _, a, b in s] for s in by_loss] == [[64, 64]] * 4
    by_tokens = packed([(64, 64)] * 8, packing.Limits(256, 8, 1))
    assert [len(s) for s in by_tokens] == [4, 4]
    # tokens 100 + 100 loss against 128 + 0: the product with the limits (256, 128) as shares decides
    first = packed([(128, 128), (100, 0)], packing.Limits(256, 8, 128))[0][0][0][0]
    assert first == (1 if 100 / 256 + 100 / 128 > 128 / 256 else 0)


def test_query_sequences_reach_the_segment_limit(spark):
    most = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("sequence_id").count().agg(F.max("count")).first()[0]
    assert most == packing.Limits().segments


def test_query(spark, sf_dir):
    docs = {r.doc_id: ids_of(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_packing(spark, sf_dir).collect()
    for r in rows:
        ids = docs[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
    assert sum(r.length for r in rows) == sum(map(len, docs.values()))
