import hashlib

import numpy as np
import pytest

from tidemark.llm import exact_dedup, mph, queries

SCHEMA = "doc_id long, text string, digest string, row_id long, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "d", 3, "n") for i, t in rows], SCHEMA).repartition(3)


def brute(rows, history=()):
    """(keep_id, group_size) of each text: null is empty, null ids are below all others."""
    groups = {}
    for i, t in [*rows, *history]:
        groups.setdefault(t or "", []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


ROWS = [(1, "a"), (2, "a"), (9, None), (4, ""), (None, "a"), (None, "only null"), (None, "only null"), (7, "tie"), (7, "tie"), (3, "A"), (5, "x" * 200_000), (6, "x" * 200_000), (-5, "neg"), (-9, "neg"), (8, " a")]


def test_without_history(spark):
    got = exact_dedup.decide(table(spark, ROWS)).collect()
    want = brute(ROWS)
    by_digest = {hashlib.sha256(t.encode()).digest(): w for t, w in want.items()}
    assert len(got) == len(ROWS) and not any(r.in_history for r in got)
    for r in got:
        assert (r.keep_id, r.group_size) == by_digest[bytes(r.digest)] and (not r.kept or r.doc_id == r.keep_id)
    kept = [bytes(r.digest) for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(want)  # one row a group, also of repeated rows
    first = exact_dedup.keep_first(table(spark, ROWS))
    assert first.columns == ["doc_id", "text", "digest", "row_id", "n"]
    assert sorted((str(r.doc_id), r.text or "") for r in first.collect()) == sorted((str(w[0]), t) for t, w in want.items())


def test_members_and_nonmembers_of_a_history(spark):
    history = [(100, "a"), (0, "neg"), (None, "only null"), (7, "tie"), (50, "never seen again"), (2, ""), (51, None)]
    want = brute(ROWS, history)
    got = exact_dedup.decide(table(spark, ROWS), table(spark, history)).collect()
    old = {t or "" for _, t in history}
    digest = {hashlib.sha256(t.encode()).digest(): t for t in want}
    assert len(got) == len(ROWS)
    for r in got:
        text = digest[bytes(r.digest)]
        assert (r.keep_id, r.group_size, r.in_history) == (*want[text], text in old)
    kept = sorted(digest[bytes(r.digest)] for r in got if r.kept)
    # members give way to a historical winner with as large an id; nonmembers are groups of their own
    assert kept == sorted([" a", "A", "only null", "x" * 200_000])


def test_history_of_many_digests_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 64)
    history = spark.range(0, 2000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    docs = spark.range(0, 3000, 3).selectExpr("id + 1000000 AS doc_id", "concat('t', id) AS text")
    rows = exact_dedup.decide(docs, history).collect()
    assert len(rows) == 1000
    assert all(r.in_history == (r.doc_id - 1_000_000 < 2000) and r.group_size == (2 if r.in_history else 1) and r.kept for r in rows)
    assert exact_dedup.keep_first(history, docs).count() == sum(i % 3 > 0 for i in range(2000))


@pytest.mark.parametrize("empty", ["docs", "history", "both"])
def test_empty_tables(spark, empty):
    none, some = spark.createDataFrame([], SCHEMA), table(spark, ROWS)
    docs, history = (none if empty != "history" else some), (none if empty != "docs" else some)
    assert len(exact_dedup.decide(docs, history).collect()) == (len(ROWS) if empty == "history" else 0)
    assert exact_dedup.keep_first(none).count() == 0


def test_query_with_half_of_the_table_as_history(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    middle = docs.approxQuantile("doc_id", [0.5], 0.0)[0]
    both = {(r.doc_id, r.keep_id, r.group_size) for r in queries.op8_exact_dedup(spark, sf_dir).collect()}
    late = exact_dedup.decide(docs.where(f"doc_id > {middle}"), docs.where(f"doc_id <= {middle}")).collect()
    assert late and {(r.doc_id, r.keep_id, r.group_size) for r in late} <= both


def digests(n, salt=b""):
    return mph.digest_matrix([hashlib.sha256(salt + str(i).encode()).digest() for i in range(n)])


@pytest.mark.parametrize("levels", [40, 2, 0])
def test_perfect_hash(monkeypatch, levels):
    """Slots are 0 to n - 1, one a digest, also where the levels end early and the tail takes the rest."""
    monkeypatch.setattr(mph, "MAX_LEVELS", levels)
    for n in (0, 1, 2, 7, 5000):
        matrix = digests(n)
        h = mph.PerfectHash.build(matrix)
        assert (len(h.tail) > 0) == (levels < 40 and n > 10 or levels == 0 and n > 0) or n < 10
        again = mph.PerfectHash.from_bytes(*h.to_bytes())
        for x in (h, again):
            slots = x.lookup(matrix)
            assert sorted(slots.tolist()) == list(range(n)) and x.slots == n
        held = np.empty_like(matrix)
        held[again.lookup(matrix)] = matrix
        others = digests(3000, b"other")
        slot = again.lookup(others)
        assert ((slot >= -1) & (slot < max(n, 1))).all()
        found = slot >= 0
        assert not (held[slot[found]] == others[found]).all(axis=1).any() if n else not found.any()
    placed = mph.PerfectHash.build(digests(5000))
    assert levels < 40 or len(placed.bits) / 5000 < 6  # bits a digest
