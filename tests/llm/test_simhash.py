import random

import numpy as np
import xxhash

from tidemark.llm import queries, simhash
from tidemark.llm.components import stars


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_and_classes_equal_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    rows = queries.op3_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_classes(fps)


def test_edge_cases(spark):
    texts = [None, "", " \t", "One", "one", "É a b", "a b c d", "A B C D", "a b c d e " * 3000, "x" * 200_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "only null id", "x"), (None, "only null id", "y"), (6, "a b c d", "x")]
    got = simhash.classes(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert np.uint64(r.fp & (2**64 - 1)) == brute_fingerprint(texts[r.doc_id])
    label = {r.doc_id: r.component_id for r in got}
    assert label[0] == label[1] == label[2] == 0 and label[4] == 3 and label[7] == 6 and label[None] is None
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(1)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["0", "3", "5", "6", "8", "9", "None"]) and len(kept[0]) == 3
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tiles_lose_no_link(spark):
    rng = random.Random(5)
    fps = set()
    while len(fps) < 600:
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.choice([0, 0, 3])):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    fps = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in fps.items()], "fp long, node long")
    roots = {r.node: r.root for r in stars(simhash.links(nodes, 4, tile=20)).collect()}
    assert {i: roots.get(i, i) for i in fps} == brute_classes(fps)


def test_components_of_a_path(spark):
    path = list(range(60))
    random.Random(3).shuffle(path)
    edges = spark.createDataFrame(list(zip(path, path[1:], strict=False)) + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in stars(edges).collect()}
    assert got == {i: 0 for i in range(1, 60)} | {101: 100}
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_lose_no_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 60_000, dtype=np.uint64)
    base = base[np.bitwise_count(base) == 32][:4000]
    moved = base[:500].copy()
    for k in range(500):  # two bits each way: the same count, four bits apart at most
        ones, zeros = ([b for b in range(64) if (int(moved[k]) >> b & 1) == v] for v in (1, 0))
        for b in [*rng.choice(ones, 2, replace=False), *rng.choice(zeros, 2, replace=False)]:
            moved[k] ^= np.uint64(1 << int(b))
    for left, right, radius in ((base, moved, 4), (moved, base, 2), (np.concatenate([base, moved]), base, 14), (base[:3], moved, 4)):
        got = {(int(i), int(j)) for a, b in simhash.linked(left, right, radius) for i, j in zip(a, b, strict=True)}
        want = {(i, int(j)) for i in range(len(left)) for j in np.flatnonzero(np.bitwise_count(left[i] ^ right) <= radius)}
        assert got == want
    assert list(simhash.linked(base[:0], base, 4)) == []


def test_repeated_doc_ids_with_different_texts(spark):
    one, two, three = "the first of these texts is about rivers", "a second one that tells of mountains and snow", "third of all and unlike the others here"
    rows = [(1, one), (1, two), (2, two.upper()), (3, three), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == sorted([(1, one), (1, two), (3, three)])
    rows = simhash.classes(docs).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == [("1", 1), ("1", 1), ("2", 1), ("3", 3), ("None", 1)]
    # texts apart that share doc_id 1, each with a neighbour of its own: two components of fingerprints
    assert len({r.root for r in rows}) == 3


def test_ids_of_all_64_bits(spark):
    ids = [2**62, 2**62 + 5, 2**63 - 1, -(2**63), -7]
    docs = spark.createDataFrame([(i, f"text of the {k}-th kind that no other row has {k * k}") for k, i in enumerate(ids)] + [(2**63 - 2, "text of the 2-th kind that no other row has 4")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.classes(docs).collect()}
    assert got == {i: i for i in ids} | {2**63 - 1: 2**63 - 2, 2**63 - 2: 2**63 - 2}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {*ids[:2], *ids[3:], 2**63 - 2}
