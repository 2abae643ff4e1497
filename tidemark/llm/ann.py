"""Approximate nearest neighbours by learned partitions.

A sample of the vectors gives a neighbour graph, which is cut into balanced parts; a small classifier learns the parts, and from
then on every vector belongs to the part it finds most probable. A query goes to its most probable parts, as many as add up to
COVER of its probability, and is compared exactly with all their vectors. Where the data have no structure that is most of them; the
probabilities are what keeps the recall.

The model is fitted on the driver, on SAMPLE vectors (about: by a hash of their place and values, at the rate that gives so many); every
row is indexed. There are more parts in a larger table (a part for each PART_ROWS rows, from PARTS up to what the sample can teach, one for
each SAMPLE_OF_PART of its vectors). Each part's rows are counted and dealt in as many blocks as its own size asks for, as are its queries;
of identical vectors in a block only as many as can be among the results are compared, by id. A query whose parts hold fewer than k
candidates is compared with all parts.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without vec_id, or
whose vectors don't have the most frequent length (of equally frequent ones, the least). Scores are cosines in double precision; ties go to
the smaller vec_id. A repeated row is a candidate for its double. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.partitions import Router, learn
from tidemark.plans.session import cut, ship

PARTS = 32
PART_ROWS = 16_384
SAMPLE = 8000
SAMPLE_OF_PART = 32
COVER = 0.95
BLOCK = 32_768  # candidates of a block, about
QUERY_BLOCK = 32_768
_ROWS = 256
_NEAR = 1e-9  # far over the rounding of a product of two unit vectors


def valid(vector: Column) -> Column:
    """True for vectors that have a cosine."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.add.reduce(x * x, axis=1))


def _route(router: Router, d: int, cover: float | None):
    """Adds the parts: the most probable one, or as many as cover asks for."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch["vec"], d)
            p = router.probabilities(x / np.abs(x).max(axis=1, keepdims=True) / _norms(x / np.abs(x).max(axis=1, keepdims=True))[:, None])
            order = np.argsort(-p, axis=1, kind="stable")
            if cover is None:
                parts = [[i] for i in order[:, 0].tolist()]
            else:
                n = 1 + (np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) < cover).sum(axis=1)
                parts = [o[:k] for o, k in zip(order.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], [*batch.schema.names, "parts"])

    return run


def exact_top(queries: np.ndarray, q_rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best candidates by cosine, ties by id; a query's own row is left out."""
    order = np.lexsort((rows, ids))
    vectors, ids, rows = vectors[order], ids[order], rows[order]
    # Identical vectors have one score: only the k + 1 with the least ids can be among the results.
    _, same = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").reshape(-1), return_inverse=True)
    by_group = np.argsort(same, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(same))])
    nth = np.empty(len(same), np.int64)
    nth[by_group] = np.arange(len(same)) - first[same[by_group]]
    kept = np.flatnonzero(nth <= k)
    vectors, ids, rows = vectors[kept], ids[kept], rows[kept]
    norms, q_norms = _norms(vectors), _norms(queries)
    unit = vectors / norms[:, None]
    found = []
    for at in range(0, len(queries), _ROWS):
        q, own = queries[at : at + _ROWS], q_rows[at : at + _ROWS]
        s = (q / q_norms[at : at + _ROWS, None]) @ unit.T
        s[rows[None, :] == own[:, None]] = -np.inf
        cut_at = np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(q), -2.0)
        i, j = np.nonzero((s >= cut_at[:, None] - _NEAR) & np.isfinite(s))
        exact = np.add.reduce(q[i] * vectors[j], axis=1) / (q_norms[at + i] * norms[j])
        best = np.lexsort((rows[j], ids[j], -exact, i))
        i, j, exact = i[best], j[best], exact[best]
        rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
        top = rank < k
        found.append((i[top] + at, order[kept[j[top]]], exact[top]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cell(d: int, k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        empty = not candidates.num_rows or not queries.num_rows
        ids, rows = candidates["vec_id"].to_numpy(), candidates["row_id"].to_numpy()
        q_ids, q_rows = queries["vec_id"].to_numpy(), queries["row_id"].to_numpy()
        i, j, s = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) if empty else exact_top(_matrix(queries["vec"], d), q_rows, _matrix(candidates["vec"], d), ids, rows, k)
        return pa.table({"query_row": pa.array(q_rows[i], pa.int64()), "query_id": pa.array(q_ids[i], pa.int64()), "row_id": pa.array(rows[j], pa.int64()), "vec_id": pa.array(ids[j], pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def _dealt(routed: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, vec_id, vec, part) with sub, their block within the part, and (part, blocks) of each part."""
    sizes = routed.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # a row for each part
    number = F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int")
    return routed.join(sizes, "part").select("row_id", "vec_id", "vec", "part", number.alias("sub")), sizes


def _compared(candidates: DataFrame, queries: DataFrame, d: int, k: int, block: int, query_block: int) -> DataFrame:
    """query_row, query_id, row_id, vec_id, score: the k best of each cell, a block of a part's candidates with a block of its queries."""
    (left, left_sizes), (right, right_sizes) = _dealt(candidates, block), _dealt(queries, query_block)
    across = lambda rows, sizes, own, other: rows.withColumnRenamed("sub", own).join(sizes, "part").select("row_id", "vec_id", "vec", "part", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(other))
    keys = ["part", "sub", "q_sub"]
    cells = across(left, right_sizes, "sub", "q_sub").groupBy(*keys).cogroup(across(right, left_sizes, "q_sub", "sub").groupBy(*keys))
    return cells.applyInArrow(_cell(d, k), "query_row long, query_id long, row_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: Column, k: int = 5, parts: int | None = None, cover: float = COVER, sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest found among vectors (vec_id, embedding) for the rows where queries holds.

    parts: by default as many as the table's size and the sample give.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.monotonically_increasing_id().alias("row_id"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = cut(rows.where(valid(F.col("vec"))))
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).agg(F.max_by(F.struct("d", "n", "q"), F.struct("n", -F.col("d")))).first()[0]
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n, _ = lengths
    rows = rows.where(F.size("vec") == d)
    steps = 1 << 40
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", "vec", "row_id", F.lit(17)), F.lit(steps)) < min(steps, steps * sample // n)).select("vec_id", "row_id", "vec").collect()
    x = np.array([r.vec for r in sorted(chosen)], np.float64).reshape(-1, d)
    x /= np.abs(x).max(axis=1, keepdims=True)
    router = learn(x / _norms(x)[:, None], parts or max(PARTS, min(n // PART_ROWS, sample // SAMPLE_OF_PART)))
    routed = lambda df, c: df.select("row_id", "vec_id", "vec").mapInArrow(_route(router, d, c), "row_id long, vec_id long, vec array<double>, parts array<int>").select("row_id", "vec_id", "vec", F.explode("parts").alias("part"))
    candidates, asked = cut(routed(rows, None)), rows.where("is_query")
    best = cut(_best(_compared(candidates, routed(asked, cover), d, k, block, query_block), k))
    full = best.groupBy("query_row").count().where(F.col("count") >= min(k, n - 1))
    lacking = asked.join(full, asked["row_id"] == full["query_row"], "left_anti")
    if not lacking.isEmpty():
        every = [F.lit(p) for p in range(router.b2.shape[0])]
        whole = _best(_compared(candidates, lacking.select("row_id", "vec_id", "vec", F.explode(F.array(*every)).alias("part")), d, k, block, query_block), k)
        best = best.join(full, "query_row", "left_semi").unionByName(whole.select(*best.columns))
    return best.select("query_id", "rank", "vec_id", "score")
