"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed character trigrams (lower case, runs of other signs as one separator), weighted by
term frequency and inverse document frequency, of length one. Each language's training vectors are clustered by cosine
(spherical k-means); a text gets the language of the nearest centroid. It is rejected where its cosine is far below what training texts
of its length reach, and where it has no letter.

The model is fitted on the driver, on at most SAMPLE labelled texts of each language (about: rows are taken by a hash of their
place, doc_id and text, at the rate that gives so many), as feature vectors computed by the executors; everything else covers all rows and whole texts.

Defined results: null text and text without a letter are "und" with score 0 and rejected; so is everything when there is nothing to learn
from. Null or repeated doc_id are documents of their own; a null doc_id counts as the empty text in the split. Of centroids equally near the
first in order of language is taken. Extra columns are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import exactly, identified, unused
from tidemark.plans.session import ship

UNKNOWN = "und"
FEATURES = 4096
SAMPLE = 600  # training texts of a language, about
CLUSTERS = 4
ROUNDS = 12
LEAST_SHARE = 0.1  # of a language's training texts; smaller clusters are mostly texts with a wrong label
HELD_OUT = 2  # of crc32(doc_id) mod 4
SLACK = 0.2  # of the low cosines seen in training
LOW = 0.01  # the quantile that counts as low
NEAR = 20  # training texts that a bin of length needs
FLOOR = 0.02  # for texts shorter than those
BINS = 24  # of text length, by powers of two

_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37


def counts(text: str | None) -> np.ndarray:
    """Hashed trigram counts of a whole text; the sum is zero if it has no letter."""
    text = text or ""
    if next(filter(str.isalpha, text), None) is None:
        return np.zeros(FEATURES, np.int64)
    c = _CLASS[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    code = (c[:-2] * 64 + c[1:-1]) * 64 + c[2:]
    return np.bincount((code * 2654435761 >> 16) % FEATURES, minlength=FEATURES)


def _weighted(matrix: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = matrix.astype(np.float32) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _bin(matrix: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.log2(1 + matrix.sum(axis=1)).astype(np.int64))


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # cosine by bin of length, under which a text is rejected

    @classmethod
    def fit(cls, labels: list[str], matrix: np.ndarray) -> Model:
        """Of training texts' labels and counts; the same rows in any order give the same model."""
        seen = matrix.sum(axis=1) > 0
        labels, matrix = [x for x, ok in zip(labels, seen, strict=True) if ok], matrix[seen]
        idf = (np.log((1 + len(labels)) / (1 + (matrix > 0).sum(axis=0))) + 1).astype(np.float32)
        x, names = _weighted(matrix, idf), np.array(labels, object)
        languages, centroids = [], []
        for name in sorted(set(labels)):
            found = _clusters(x[names == name])
            languages += [name] * len(found)
            centroids.append(found)
        c = np.concatenate(centroids) if centroids else np.zeros((0, FEATURES), np.float32)
        least = np.zeros(BINS)
        if len(c):
            best, bins = (x @ c.T).max(axis=1), _bin(matrix)
            near = [best[np.abs(bins - b) <= 1] for b in range(BINS)]
            known = [b for b in range(BINS) if len(near[b]) >= NEAR]
            for b in range(BINS):
                if known and b >= known[0]:
                    least[b] = SLACK * np.quantile(near[max(k for k in known if k <= b)], LOW)
                else:  # shorter than what was seen in training
                    least[b] = FLOOR
        return cls(languages, c, idf, least)

    def predict(self, matrix: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each row of counts."""
        if not self.languages:
            return [UNKNOWN] * len(matrix), np.zeros(len(matrix)), np.ones(len(matrix), bool)
        cosines = _weighted(matrix, self.idf) @ self.centroids.T
        best, empty = cosines.argmax(axis=1), matrix.sum(axis=1) == 0
        score = np.where(empty, 0.0, np.clip(cosines.max(axis=1), 0, 1).astype(np.float64))
        names = [UNKNOWN if e else self.languages[i] for i, e in zip(best.tolist(), empty.tolist(), strict=True)]
        return names, score, empty | (score < self.least[_bin(matrix)])


def _clusters(x: np.ndarray) -> np.ndarray:
    """Spherical k-means, begun with rows from even places in the order of their cosine with the mean."""
    order = np.argsort(x @ x.mean(axis=0), kind="stable")
    k = min(CLUSTERS, len(x))
    c = x[order[[(2 * i + 1) * len(x) // (2 * k) for i in range(k)]]]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    share = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c)) / len(x)
    return c[share >= min(LEAST_SHARE, share.max())].astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counts(t.as_py()).astype("<u4").tobytes() for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["key"], batch["lang"], pa.array(rows, pa.binary())], ["key", "lang", "counts"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the text and lang of the rows of docs (doc_id, text, lang) that are not held out, of about sample rows a language.

    Rows are chosen by their own place (see identified) with doc_id and text, so that a null or repeated doc_id changes nothing. A language
    whose rows are all held out, as under a single doc_id, is learnt from those.
    """
    ship(docs.sparkSession)
    placed, row = identified(docs.where("lang is not null"))
    labelled = placed.select("doc_id", "text", "lang", exactly(row).alias("row_id"), held_out(F.col("doc_id")).alias("out"))
    counted = {r.lang: (r.n, r.own) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~F.col("out")).alias("own")).collect()}
    sizes = {lang: own or n for lang, (n, own) in counted.items()}
    known = labelled.where(~F.col("out") | F.col("lang").isin([lang for lang, (_, own) in counted.items() if not own])).select(F.col("doc_id").cast("string").alias("key"), "text", "lang", "row_id")
    if not sizes:
        return Model.fit([], np.zeros((0, FEATURES), np.int64))
    steps = 1 << 20
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(steps, -(-sample * steps // n)))])
    hashed = F.pmod(F.xxhash64("key", "text", "row_id", F.lit(11)), F.lit(steps))
    chosen = known.where(hashed < F.element_at(rate, F.col("lang"))).drop("row_id")
    rows = sorted(chosen.mapInArrow(_features, "key string, lang string, counts binary").collect(), key=lambda r: (r.lang, r.key or "", bytes(r.counts)))
    matrix = np.frombuffer(b"".join(bytes(r.counts) for r in rows), "<u4").reshape(-1, FEATURES)
    return Model.fit([r.lang for r in rows], matrix)


def _predict(model: Model, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found, score, rejected = model.predict(np.stack([counts(t.as_py()) for t in batch.column(text)]))
                arrays = [*batch.columns, pa.array(found), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(arrays, [f"c{k}" for k in range(len(arrays))])

    return run


ADDED = ("lang_pred", "lang_score", "lang_rejected")


def classified(docs: DataFrame, model: Model, added: tuple[str, str, str] | list[str] = ADDED) -> DataFrame:
    """docs with the language, the score (the cosine, 0 to 1) and the rejection, under the names of added, which docs must not have."""
    if unused(docs.columns, *added) != list(added):
        raise ValueError(f"docs has columns of these names already: {added}")
    ship(docs.sparkSession)
    kinds = [*[f.dataType for f in docs.schema.fields], T.StringType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([T.StructField(f"c{k}", kind) for k, kind in enumerate(kinds)])  # plain names on the way, whatever those of docs are
    plain = docs.toDF(*schema.names[: len(docs.columns)])
    return plain.mapInArrow(_predict(model, docs.columns.index("text")), schema).toDF(*docs.columns, *added)


def keep_known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that are not rejected, with their columns; the model is fitted on docs if none is given."""
    added = unused(docs.columns, *ADDED)
    return classified(docs, model or fit(docs), added).where(~exactly(added[2])).select(*map(exactly, docs.columns))
