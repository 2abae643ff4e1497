import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, partitions, queries


def brute(rows, is_query, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (qi, q) in enumerate(ok):
        if is_query(qi):
            scored = [(-float((q * c).sum() / (np.sqrt((q * q).sum()) * np.sqrt((c * c).sum()))), ci) for m, (ci, c) in enumerate(ok) if m != n]
            out.setdefault(qi, []).append(sorted(scored)[:k])
    return out


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = {q: x[0] for q, x in brute(rows, lambda i: i % 50 == 0).items()}
    got = {}
    for r in queries.op4_ann(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    vectors = {i: np.array(v, float) for i, v in rows}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        for _, i, s in found:
            assert i != q and s == pytest.approx(vectors[q] @ vectors[i] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[i]), abs=1e-14)
        hits += len({f[1] for f in found} & {i for _, i in want[q]})
    assert hits / (5 * len(want)) >= 0.95


def test_odd_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(60)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]
    rows += [(2000, None), (2050, []), (2100, [0.0] * 4), (2150, [1.0, None, 1.0, 1.0]), (2200, [float("nan"), 1.0, 1.0, 1.0]), (2250, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (50, [1.0, 1.0, 0.0, 0.0]), (2300, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, part string").repartition(3)
    want = brute([r for r in rows if r[0] != 2300], lambda i: i % 50 == 0)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, cover=1.1, block=2, query_block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    for q, lists in want.items():
        found = sorted(got[q])
        assert sorted(i for _, i, _ in found) == sorted(i for x in lists for _, i in x)
    assert [i for _, i, _ in sorted(got[1050])] == [1000, 1001, 1002, 1003, 1004]


def test_too_few_found_are_looked_for_in_all_parts(spark):
    """Two far groups and parts of their own: three candidates are all that a query's part holds, and the rest comes from the other one."""
    rng = np.random.default_rng(2)
    rows = [(50 * i, [1.0, 0.001 * i, 0.0, 0.0]) for i in range(4)] + [(50 * i + 1, [0.0, 0.0, 1.0, float(x)]) for i, x in enumerate(rng.normal(0, 0.01, 200))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, cover=1e-9, parts=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute(rows, lambda i: i % 50 == 0)
    assert set(got) == set(want) and all(len(g) == 5 for g in got.values())
    for q in (0, 50, 100, 150):
        assert {0, 50, 100, 150} - {q} <= {i for _, i in got[q]}


def test_a_hot_part_is_split_by_its_own_size(spark):
    rows = [(i, [1.0, 1e-6 * i, 0.0]) for i in range(900)] + [(1000 + i, [0.0, 0.01 * i, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    routed = df.selectExpr("vec_id AS row_id", "vec_id", "embedding AS vec", "int(vec_id >= 1000) AS part")
    dealt, sizes = ann._dealt(routed, 100)
    assert {r.part: r.blocks for r in sizes.collect()} == {0: 9, 1: 1}
    assert max(r["count"] for r in dealt.groupBy("part", "sub").count().collect()) < 160
    got = {(r.query_id, r["rank"]): r.score for r in ann.search(df, F.col("vec_id") % 50 == 0, cover=1.1, block=100, query_block=7).collect()}
    want = {(q, k + 1): -s for q, lists in brute(rows, lambda i: i % 50 == 0).items() for k, (s, _) in enumerate(lists[0])}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    rows = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None)], schema), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 1)]
    assert ann.search(spark.createDataFrame([(0, [1.0, 0.0])], schema), F.col("vec_id") % 50 == 0).count() == 0


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 16)) * 3
    x = np.concatenate([c + rng.standard_normal((100, 16)) * 0.3 for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = partitions.balanced_parts(partitions.nearest(x, 10), 8)
    assert np.bincount(part, minlength=8).tolist() == [100] * 8
    assert sum(len(set(part[i * 100 : i * 100 + 100])) == 1 for i in range(8)) >= 6
    p = partitions.learn(x, 8).probabilities(x)
    assert (p.max(axis=1) > 0.8).mean() > 0.9
