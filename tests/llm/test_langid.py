import math
import zlib

import numpy as np
import pytest

from tidemark.llm import langid, queries


def test_held_out_accuracy(spark):
    rows = queries.op5_langid(spark, "/root/testdata/sf0.01").collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(langs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(out) > 150 and sum(out) / len(out) >= 0.97
    assert not any(r.rejected for r in rows)  # all of them are prose of a known language


def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.fit(docs)


def test_rejection_and_odd_rows(spark):
    texts = [None, "", "12345 !?", "Привет, это русский текст на кириллице. " * 20, "日本語のテキスト" * 50, "zxq vbk jjw qqp " * 50, "The erre of the and that is onan. " * 9, "The erre of the and that is onan. " * 9]
    docs = spark.createDataFrame([(i if i < 6 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    rows = langid.classified(docs, model(spark)).collect()
    assert [r["lang_pred"] for r in rows][:3] == ["und"] * 3 and [r["lang_rejected"] for r in rows] == [True] * 6 + [False] * 2
    assert [r["lang_pred"] for r in rows][6:] == ["en", "en"] and [r["lang_score"] for r in rows][:3] == [0, 0, 0]
    kept = langid.keep_known(docs, model(spark))
    assert kept.columns == docs.columns and kept.count() == 2


def brute_counts(text):
    """Trigram counts by their definition: bytes to classes, runs of other signs as one separator, three classes hashed to a feature."""
    out = [0] * langid.FEATURES
    if not any(c.isalpha() for c in text or ""):
        return out
    signs = []
    for b in b" " + text.lower().encode() + b" ":
        c = b - ord("a") + 1 if ord("a") <= b <= ord("z") else 27 + (b - 128) % 37 if b >= 128 else 0
        if c or not signs or signs[-1]:
            signs.append(c)
    for x, y, z in zip(signs, signs[1:], signs[2:], strict=False):
        out[(((x * 64 + y) * 64 + z) * 2654435761 >> 16) % langid.FEATURES] += 1
    return out


def test_predictions_equal_brute_force(spark):
    """Every centroid's cosine with every text, one by one in double precision."""
    m = model(spark)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [None, "", "?!", "Ça été Übermut", "the THE the", "x", "Привет", "a\x00b \U0001d11e z" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(langid.classified(docs, m).collect())
    assert len(rows) == len(texts)
    for r in rows:
        c = brute_counts(r.text)
        w = [x * float(i) for x, i in zip(c, m.idf, strict=True)]
        norm = math.sqrt(math.fsum(x * x for x in w))
        cosines = [math.fsum(a * float(b) for a, b in zip(w, centroid, strict=True) if a) / norm if norm else 0.0 for centroid in m.centroids]
        best = max(cosines)
        assert r.lang_score == pytest.approx(max(0.0, best), abs=1e-5)
        if not sum(c):
            assert (r.lang_pred, r.lang_score, r.lang_rejected) == ("und", 0, True)
            continue
        assert r.lang_pred in {m.languages[i] for i, x in enumerate(cosines) if x > best - 1e-5}
        least = m.least[min(langid.BINS - 1, int(math.log2(1 + sum(c))))]
        assert abs(best - least) < 1e-5 or r.lang_rejected == (best < least)


def foreign(rng, n):
    """Texts in no learned language: other scripts, encoded data, noise."""
    draw = lambda letters, k: "".join(rng.choice(list(letters), k))
    scripts = ["абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "あいうえおかきくけこさしすせそ日本語", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغ", "กขคงจฉชซฌญฎฏฐฑ"]
    made = []
    for k in range(n):
        words = int(rng.integers(20, 400))
        kind = k % 9
        if kind < 6:
            made.append(("script", " ".join(draw(scripts[kind], rng.integers(2, 9)) for _ in range(words))))
        elif kind == 6:
            made.append(("base64", draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", words * 6)))
        elif kind == 7:
            made.append(("hex", draw("0123456789abcdef", words * 6)))
        else:
            made.append(("noise", " ".join(draw("bcdfghjklmnpqrstvwxz", rng.integers(2, 9)) for _ in range(words))))
    return made


def test_rejection_precision_and_recall(spark):
    """On prose mixed with as many texts of no learned language: what is rejected is foreign, and the foreign is rejected."""
    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    other = foreign(np.random.default_rng(3), len(prose))
    docs = spark.createDataFrame([(i, t, "prose") for i, t in enumerate(prose)] + [(len(prose) + i, t, kind) for i, (kind, t) in enumerate(other)], "doc_id long, text string, kind string")
    rows = langid.classified(docs, model(spark)).collect()
    hits, rejected = sum(r.lang_rejected for r in rows if r.kind != "prose"), sum(r.lang_rejected for r in rows)
    by_kind = {k: (sum(r.lang_rejected for r in rows if r.kind == k), sum(r.kind == k for r in rows)) for k in {r.kind for r in rows}}
    print("rejected of all, by kind:", by_kind)
    assert hits / max(1, rejected) >= 0.99 and hits / len(other) >= 0.9, by_kind


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.keep_known(empty).count() == 0
    rows = langid.classified(spark.createDataFrame([(1, "words")], "doc_id long, text string"), langid.fit(empty)).collect()
    assert rows[0]["lang_pred"] == "und" and rows[0]["lang_rejected"]


def test_several_centroids_and_order():
    rng = np.random.default_rng(0)
    texts = [(lang, " ".join(rng.choice(words, 40))) for lang, words in (("a", ["the", "and", "that", "then"]), ("b", ["der", "die", "und", "ein"])) for _ in range(60)]
    matrix = np.stack([langid.counts(t) for _, t in texts])
    m = langid.Model.fit([x for x, _ in texts], matrix)
    assert 2 < len(m.languages) <= 2 * langid.CLUSTERS and np.allclose(np.linalg.norm(m.centroids, axis=1), 1, atol=1e-5)
    assert m.predict(matrix)[0] == [x for x, _ in texts]
    assert langid.counts("é" * 70_000 + " x").sum() > 70_000


def test_sample_size_does_not_hang_on_doc_id(spark, monkeypatch):
    texts = {"en": "the and that then of with", "de": "der die und ein mit von"}
    sizes = []
    fit = langid.Model.fit
    monkeypatch.setattr(langid.Model, "fit", lambda languages, matrix: sizes.append({x: languages.count(x) for x in texts}) or fit(languages, matrix))
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == langid.HELD_OUT)
    for doc_id in ("null", "7", str(held)):
        for text in ("concat(t, ' ', id)", "t"):  # texts of their own, or one text a language
            docs = spark.range(2000).selectExpr(f"cast({doc_id} as long) AS doc_id", "id", f"explode(map('en', '{texts['en']}', 'de', '{texts['de']}')) AS (lang, t)").selectExpr("doc_id", "lang", f"{text} AS text")
            langid.fit(docs, 100)
            assert all(50 <= n <= 150 for n in sizes[-1].values()), (doc_id, text, sizes[-1])
