"""Batch writes as relations of mutations.

A batch is one DataFrame, validated as a whole and committed by one write: either all of it becomes part of the log or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import check_key, valid_key, valid_value
from tidemark.operators.order import numbered
from tidemark.operators.resolve import MUTATION

_COLUMNS = [f.name for f in MUTATION]


def puts(rows: DataFrame, first_seq: int, source: str = "local") -> DataFrame:
    """Mutations that put the rows (key, value, perhaps expire_at), numbered from first_seq in order of key."""
    expire = F.col("expire_at").cast("long") if "expire_at" in rows.columns else F.lit(None).cast("long")
    checked = rows.select(valid_key(F.col("key")).alias("key"), valid_value(F.col("value")).alias("value"), expire.alias("expire_at"))
    return numbered(checked, "key", "seq", first_seq).select("key", "value", "seq", F.lit(False).alias("tombstone"), "expire_at", F.lit(source).alias("source"))


def mput(spark: SparkSession, entries: dict[str, str], first_seq: int, source: str = "local") -> DataFrame:
    """B1: mutations of a batch that the driver holds, in the order of its entries."""
    if not entries:
        raise ValueError("an empty batch")
    rows = []
    for i, (k, v) in enumerate(entries.items()):
        if v is None:
            raise ValueError("a value must not be null")
        rows.append((check_key(k), v, first_seq + i, False, None, source))
    return spark.createDataFrame(rows, MUTATION)


def mdelete(spark: SparkSession, keys: list[str], first_seq: int, source: str = "local") -> DataFrame:
    """Tombstones for the keys; absent ones do no harm."""
    if not keys:
        raise ValueError("an empty batch")
    return spark.createDataFrame([(check_key(k), None, first_seq + i, True, None, source) for i, k in enumerate(keys)], MUTATION)


def deletes(keys: DataFrame, first_seq: int, source: str = "local") -> DataFrame:
    """Tombstones for a relation of keys (key); S7 is the deletion of all keys of a view."""
    checked = numbered(keys.select(valid_key(F.col("key")).alias("key")), "key", "seq", first_seq)
    return checked.select("key", F.lit(None).cast("string").alias("value"), "seq", F.lit(True).alias("tombstone"), F.lit(None).cast("long").alias("expire_at"), F.lit(source).alias("source"))


def appended(log: DataFrame, mutations: DataFrame) -> DataFrame:
    """The log with a batch at its end."""
    return log.unionByName(mutations, allowMissingColumns=True)
