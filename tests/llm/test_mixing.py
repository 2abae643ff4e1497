import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Iterative resharing, as the definition has it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in done]
        if not free:
            return done
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 2.0 * sizes[s] for s in over}


def rows_of(spark, n=300):
    rows = [(i, "w " * (i % 17), f"s{i % 7 if i % 3 else 0}", "x") for i in range(n)]
    rows += [(None, None, None, "x"), (n + 9, "a b\tc", None, "x"), (n + 9, "a b\tc", None, "x"), (n, "only　one \x0bword", "Ω", "x"), (n + 1, "", "empty", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard string").repartition(3)


SMALL = {"shards": 8, "blocks_per_shard": 8, "block_words": 1}


def drawn(rows, width):
    """By brute force, from the drawn blocks and the documents' places: words taken by (row, shard)."""
    mixed, blocks = rows
    out = defaultdict(int)
    for b in blocks:
        first = b.block * width
        for r in mixed:
            if r.source_key == b.source_key:
                n = min(r["at"] + r["size"], first + b.words) - max(r["at"], first)
                if n > 0:
                    out[r.row_id, b.shard] += n
    return out


def test_targets_and_totals(spark):
    docs = rows_of(spark)
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = mixing.mix(docs, **SMALL).taken().collect()
    assert len(rows) == 305 and len({r.row_id for r in rows}) == 305
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[source[r.doc_id]] += r["size"]
    want = brute_targets(dict(sizes))
    for r in rows:
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)


def test_pieces_and_sums_come_from_the_shards_blocks(spark):
    mixed = mixing.mix(rows_of(spark), **SMALL)
    want = drawn((mixed.rows.collect(), mixed.blocks.collect()), mixed.width)
    got, by_row = defaultdict(int), defaultdict(int)
    seen = set()
    for r in mixed.pieces().collect():
        got[r.row_id, r.shard] += r.end - r.begin
        words = {(r.row_id, r.epoch, w) for w in range(r.begin, r.end)}
        assert words and not words & seen and 0 <= r.begin < r.end <= r["size"]
        seen |= words
    assert got == want
    for (row, _), n in want.items():
        by_row[row] += n
    assert {r.row_id: r.taken for r in mixed.taken().collect() if r.taken} == by_row


def test_shards_hold_what_the_tree_gives_them(spark):
    mixed = mixing.mix(rows_of(spark), **SMALL)
    blocks = mixed.blocks.collect()
    keys = sorted({b.source_key for b in blocks})
    counts = spark.createDataFrame([(keys.index(k), n) for k, n in Counter(b.source_key for b in blocks).items()], "rank int, blocks long")
    quota = {(r.shard, r["rank"]): r.n for r in mixing.splitting_tree(counts, 8).collect()}
    totals = Counter(b.source_key for b in blocks)
    assert {k: sum(n for (_, r), n in quota.items() if keys[r] == k) for k in keys} == totals
    per_shard = Counter(b.shard for b in blocks)
    assert max(per_shard.values()) - min(per_shard.values()) <= 3  # a place more or less at each level
    assert len({(b.source_key, b.epoch, b.block) for b in blocks}) == len(blocks)


def test_without_the_trees_output_nothing_is_taken(spark, monkeypatch):
    tree = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a, **k: tree(*a, **k).where("false"))
    rows = queries.op2_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and not any(r.taken for r in rows)


def test_tree_gives_exact_quotas_and_full_shards(spark):
    blocks = {0: 37, 1: 0, 2: 5, 3: 91, 4: 1}
    sources = spark.createDataFrame(list(blocks.items()), "rank int, blocks long")
    rows = mixing.splitting_tree(sources, 11).collect()
    assert all(r.n > 0 for r in rows) and len({(r.shard, r["rank"]) for r in rows}) == len(rows)
    assert {k: sum(r.n for r in rows if r["rank"] == k) for k in blocks} == blocks
    per_shard = [sum(r.n for r in rows if r.shard == s) for s in range(11)]
    assert sum(per_shard) == 134 and max(per_shard) - min(per_shard) <= 3
    deep = mixing.splitting_tree(sources, 700).collect()  # beyond SPREAD_LEVEL, and more shards than blocks
    assert {k: sum(r.n for r in deep if r["rank"] == k) for k in blocks} == blocks and max(Counter(r.shard for r in deep).values()) <= 2


def test_draws_are_hypergeometric(spark):
    for n, total, left in ((10, 40, 20), (3, 7, 5), (600, 2000, 500), (1, 1, 1), (5, 9, 0), (4, 4, 2)):
        us = [(i + 0.5) / 4000 for i in range(4000)]
        df = spark.createDataFrame([(u,) for u in us], "u double")
        got = Counter(r[0] for r in df.select(mixing._drawn(*[F.lit(x).cast("long") for x in (n, total, left)], F.col("u"))).collect())
        ways = {k: math.comb(left, k) * math.comb(total - left, n - k) for k in range(max(0, left + n - total), min(n, left) + 1)}
        whole = sum(ways.values())
        assert set(got) <= set(ways) and all(abs(got[k] / 4000 - w / whole) < 1e-3 for k, w in ways.items())


def test_mixed_documents(spark, tmp_path):
    rows_of(spark).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    options = {"shards": 4, "blocks_per_shard": 4, "block_words": 1}
    mixed = mixing.mixed_documents(docs, **options)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert sum(len(WORD.findall(r.text)) for r in rows) == sum(r.taken for r in mixing.mix(docs, **options).taken().collect())
    again = mixing.mixed_documents(docs, **options).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_many_rows_of_one_doc_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    docs = spark.range(0, 900, 1, 3).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) AS doc_id", "repeat('w ', int(id % 5)) AS text", "'s' AS source")
    mixed = mixing.mix(docs, **SMALL)
    rows = mixed.rows.collect()
    spans = sorted((r["at"], r["at"] + r["size"]) for r in rows if r["size"])
    assert len(rows) == 900 and spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(r.taken for r in mixed.taken().collect()) == round(1.5 * spans[-1][1])


def test_words_between_gives_the_text_back(spark):
    texts = ["\n a  b c ", "a", "é𝄞 x\t", "  lead", "trail  \r\n"]
    for t in texts:
        n = len(WORD.findall(t))
        for cuts in ([0, n], [0, 1, n], list(range(n + 1))):
            df = spark.createDataFrame([(t, a, b, k) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))], "t string, a long, b long, k int")
            parts = [r.x for r in df.select("k", mixing.words_between(F.col("t"), F.col("a"), F.col("b")).alias("x")).orderBy("k").collect()]
            assert "".join(parts) == t and [len(WORD.findall(p)) for p in parts] == [b - a for a, b in zip(cuts, cuts[1:], strict=False)]


def test_empty_tables(spark):
    empty = mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert empty.taken().count() == 0 and empty.pieces().count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).taken().collect()] == [0, 0]


def test_names_that_clash(spark):
    names = ["__row", "row_id", "id", "size", "begin", "end", "shard", "order", "words", "block", "epoch", "part", "at", "source_key", "with.dot", "_metadata"]
    docs = spark.createDataFrame([(i, f"word{i} " * 3, f"s{i % 3}", *[f"{n}-{i}" for n in names]) for i in range(40)], ["doc_id", "text", "source", *names])
    rows = mixing.mixed_documents(docs).collect()
    assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)


def test_query_has_every_document(spark, sf_dir):
    rows = queries.op2_mixing(spark, sf_dir).collect()
    assert len(rows) == 200 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
