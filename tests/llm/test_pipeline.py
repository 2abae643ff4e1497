from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_mixing import WORD, brute_targets
from tests.llm.test_packing import ids_of
from tests.llm.test_simhash import brute_classes, brute_fingerprint

from tidemark.llm import langid


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_equal_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    at = {c: i for i, c in enumerate(columns)}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, result = rows_of(docs), stage(spark, docs, sf)
        if name != "packing":
            assert result.columns == columns
            result.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
        after = rows_of(docs) if name != "packing" else result.collect()
        texts = {r[at["doc_id"]]: r[at["text"]] for r in before}
        if name == "language ID":
            rejected = [r.doc_id for r in langid.classified(docs, langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))).where("lang_rejected").collect()]
            assert set(after) <= set(before) and not rejected and len(after) > 0.95 * len(before)
        elif name == "exact dedup":
            keep = {max(d for d, t in texts.items() if t == text) for text in texts.values()}
            assert sorted(after) == sorted(r for r in before if r[at["doc_id"]] in keep)
        elif name == "SimHash near-dedup":
            keep = set(brute_classes({d: brute_fingerprint(t) for d, t in texts.items()}).values())
            assert sorted(after) == sorted(r for r in before if r[at["doc_id"]] in keep)
        elif name == "mixing sources":
            words, taken = defaultdict(int), defaultdict(int)
            for r in before:
                words[r[at["source"]]] += len(WORD.findall(r[at["text"]]))
            for r in after:
                taken[r[at["source"]]] += len(WORD.findall(r[at["text"]]))
                assert r[at["text"]] in texts[r[at["doc_id"]]]
            assert all(abs(taken[s] - t) <= 0.5 for s, t in brute_targets(dict(words)).items())
        else:
            total = sum(len(ids_of(r[at["text"]])) for r in before)
            assert sum(r.length for r in after) == total
            by_seq = defaultdict(list)
            for r in after:
                by_seq[r.sequence_id].append((r.offset, r.length))
            for pieces in by_seq.values():
                pieces.sort()
                n = sum(x for _, x in pieces)
                assert [o for o, _ in pieces] == [sum(x for _, x in pieces[:i]) for i in range(len(pieces))] and (n == 4096 or n & (n - 1) == 0)


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.length for r in rows) > 10_000




SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, label string, kept boolean, __row long, id long, words string"


def odd_table(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    extra = ("r", "l", True, 1, 2, "w")
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t), *extra) for i, t in enumerate(prose)]
    rows += [(None, None, None, None, None, None, None, None, None, None, None), (None, None, "en", "s1", 0, *extra), (100, "", "en", "s1", 0, *extra), (101, "  \n", None, None, 3, *extra)]
    rows += [rows[3], rows[3], (None, prose[4], "en", "s1", 9, *extra), (102, prose[5] * 40, "en", "s2", 9, *extra), (103, "word " * 30_000, "en", "s2", 9, *extra)]
    sf = odd_table(spark, rows, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, sf)
        assert name == "packing" or result.columns == docs.columns
        result.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "exact dedup":
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(set(texts)) and set(prose[:3]) <= set(texts)
    assert docs.count() > 30 and docs.where("doc_id is null and length > 0").count() == docs.where("doc_id is null").count()


NAMES = ["__row", "row_id", "ID", "label", "fp", "root", "node", "tile", "a", "b", "key", "digest", "member", "keep_id", "kept", "shard", "size", "words", "begin", "end", "order", "epoch", "block", "lang_pred", "lang_score", "lang_rejected", "__lang_pred", "out", "with.dot", "back`tick", "_metadata"]


def test_values_of_clashing_columns_survive(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clashing = docs.select("*", *[F.concat(F.lit(f"{k}-"), "doc_id").alias(n) for k, n in enumerate(NAMES)])
    for files in (False, True):
        if files:
            clashing.drop("_metadata").write.parquet(str(tmp_path / "docs"))
            clashing = spark.read.parquet(str(tmp_path / "docs"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            result = stage(spark, clashing, None)
            assert result.columns == clashing.columns
            rows = result.collect()
            assert len(rows) > 50 and all(r[n] == f"{NAMES.index(n)}-{r.doc_id}" for r in rows for n in NAMES if n in result.columns), name


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_table(spark, [], tmp_path)).count() == 0
