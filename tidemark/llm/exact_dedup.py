"""Exact deduplication through a minimal perfect hash over historical distinct digests.

The index has one row per shard of the digest space: the hash's bits, and by slot the full 32-byte digest, the
locator (doc_id, row) of the winner and the number of rows. A batch's distinct digests (counted before they are
shuffled, so that a group with a third of all rows stays small) look up their slot and compare the bytes; members
meet the historical winner, nonmembers are groups of their own. Without a given history the batch registers
its own digests first.

Defined results: null text is the empty text. Of equal texts the row with the largest doc_id stays; a null doc_id
is below all others; among rows with the same doc_id and text, one stays. Extra columns are kept, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import chosen_rows, identified, row_number
from tidemark.llm.mph import PerfectHash, digest_matrix
from tidemark.plans.session import cut, ship

SHARD_DIGESTS = 16_384  # distinct digests per index row, about
INDEX_SCHEMA = "shard long, n long, sizes binary, bits binary, tail binary, digests binary, win_doc binary, win_row binary, win_null binary, counts binary"
FOUND_SCHEMA = "digest binary, member boolean, keep_id long, keep_row long, group_size long"


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row_id, doc_id and the SHA-256 digest of each whole text; computed once. row: the column that numbers the rows."""
    return cut(
        docs.select(
            row_number(row).alias("row_id"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"),
        )
    )


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: its winner's locator and the number of rows. Summed before the shuffle."""
    return (
        rows.groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row_id")).alias("w"), F.count("*").alias("n"))
        .select("digest", F.col("w.doc_id").alias("doc_id"), F.col("w.row_id").alias("row_id"), "n")
    )


def _sharded(distinct: DataFrame, shards: int) -> DataFrame:
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return distinct.withColumn("shard", F.pmod(head, F.lit(shards)))


def _build(key: tuple, table: pa.Table) -> pa.Table:
    matrix = digest_matrix(table["digest"].to_pylist())
    mph = PerfectHash.build(matrix)
    order = np.argsort(mph.lookup(matrix))
    null, doc = np.asarray(table["doc_id"].is_null()), table["doc_id"].fill_null(0).to_numpy()
    sizes, bits, tail = mph.to_bytes()
    by_slot = lambda x, kind: np.ascontiguousarray(np.asarray(x)[order].astype(kind)).tobytes()
    return pa.table(
        {
            "shard": pa.array([key[0].as_py()], pa.int64()),
            "n": pa.array([len(matrix)], pa.int64()),
            "sizes": [sizes],
            "bits": [bits],
            "tail": pa.array([tail], pa.binary()),
            "digests": [matrix[order].tobytes()],
            "win_doc": [by_slot(doc, np.int64)],
            "win_row": [by_slot(table["row_id"].to_numpy(), np.int64)],
            "win_null": [by_slot(null, np.uint8)],
            "counts": [by_slot(table["n"].to_numpy(), np.int64)],
        }
    )


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """The index of (digest, doc_id, row_id, n) rows with distinct digests."""
    ship(distinct.sparkSession)
    return _sharded(distinct, shards).groupBy("shard").applyInArrow(_build, INDEX_SCHEMA)


def _probe(own_history: bool):
    def probe(batch: pa.Table, index: pa.Table) -> pa.Table:
        n = batch.num_rows
        doc, row, count = batch["doc_id"].to_pylist(), batch["row_id"].to_pylist(), batch["n"].to_pylist()
        member = np.zeros(n, bool)
        if n and index.num_rows:
            x = {c: index[c][0].as_py() for c in index.column_names}
            matrix, held = digest_matrix(batch["digest"].to_pylist()), np.frombuffer(x["digests"], np.uint8).reshape(-1, 32)
            slot = PerfectHash.from_bytes(x["sizes"], x["bits"], x["tail"]).lookup(matrix)
            member = slot >= 0
            member[member] = (held[slot[member]] == matrix[member]).all(axis=1)  # byte-checked
            win_doc, win_row, counts = (np.frombuffer(x[c], np.int64) for c in ("win_doc", "win_row", "counts"))
            win_null = np.frombuffer(x["win_null"], np.uint8)
            for i in np.flatnonzero(member).tolist():
                s = slot[i]
                old = None if win_null[s] else int(win_doc[s])
                if own_history:
                    doc[i], row[i], count[i] = old, int(win_row[s]), int(counts[s])
                else:
                    count[i] += int(counts[s])
                    if old is not None and (doc[i] is None or old >= doc[i]):  # what came first stays on a tie
                        doc[i], row[i] = old, -1
        return pa.table(
            {
                "digest": batch["digest"].cast(pa.binary()),
                "member": pa.array(member),
                "keep_id": pa.array(doc, pa.int64()),
                "keep_row": pa.array(row, pa.int64()),
                "group_size": pa.array(count, pa.int64()),
            }
        )

    return probe


def decide(docs: DataFrame, history: DataFrame | None = None, row: str | None = None) -> DataFrame:
    """row_id, doc_id, keep_id, group_size, kept, digest, in_history for each row of docs (doc_id, text).

    history: documents seen before (doc_id, text); the group sizes count them. None: docs is its own history.
    """
    rows = digests(docs, row)
    batch = distinct_digests(rows)
    past = batch if history is None else distinct_digests(digests(history))
    shards = max(1, -(-(rows.count() if history is None else past.count()) // SHARD_DIGESTS))
    index = build_index(past, shards)
    found = _sharded(batch, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe(history is None), FOUND_SCHEMA)
    return rows.join(found, "digest").select(
        "row_id",
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        "digest",
        (F.col("member") & F.lit(history is not None)).alias("in_history"),
    )


def keep_first(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows, row = identified(docs)
    kept = decide(rows, history, row).where("kept").select("row_id", F.col("doc_id").alias("id"))
    return chosen_rows(rows, row, kept, docs.columns)
