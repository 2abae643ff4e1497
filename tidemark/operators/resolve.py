"""Version resolution: the newest mutation of each key, and the relations that follow from it.

A mutation is a row (key, value, seq, tombstone) and perhaps more. The newest has the highest seq; of equal ones that from the first
source wins (rank of the source, from 0), so results do not depend on the order of rows. The aggregate is associative, so Spark combines
before the shuffle, and a hot key costs one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import entry_bytes

MUTATION = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType()),
        T.StructField("seq", T.LongType(), False),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("expire_at", T.LongType()),
        T.StructField("source", T.StringType()),
    ]
)
FLUSH_BYTES = 64 << 20


def newest(df: DataFrame, by: list[str] | str = "key", seq: str = "seq", rank: str | None = None) -> DataFrame:
    """Of the rows with the same by columns, the one with the highest seq, then the lowest rank (0 if there is none), whole."""
    by = [by] if isinstance(by, str) else by
    rest = [c for c in df.columns if c not in by and c not in (seq, rank)]
    # One struct is order and content at once; rows that agree in seq and rank are told apart by the rest, so that reruns agree.
    fields = [F.col(seq).alias("_seq"), *([(-F.col(rank)).alias("_rank")] if rank else []), *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)]]
    won = {seq: F.col("_w._seq"), **({rank: -F.col("_w._rank")} if rank else {}), **{c: F.col(f"_w._{i}") for i, c in enumerate(rest)}}
    return df.groupBy(*by).agg(F.max(F.struct(*fields)).alias("_w")).select(*by, *[won[c].alias(c) for c in df.columns if c not in by])


def merge(*runs: DataFrame) -> DataFrame:
    """The newest rows of several runs; on equal seq the run that comes first wins."""
    if not runs:
        raise ValueError("nothing to merge")
    ranked = [r.withColumn("_rank", F.lit(i)) for i, r in enumerate(runs)]
    return newest(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked), rank="_rank").drop("_rank")


def live(resolved: DataFrame) -> DataFrame:
    """Without tombstones. Only after resolution: a tombstone must first beat what it deletes."""
    return resolved.where(~F.col("tombstone"))


def view(log: DataFrame, rank: str | None = None) -> DataFrame:
    """The live (key, value) relation of a log of mutations."""
    return live(newest(log, rank=rank)).select("key", "value")


def either(a: Column, b: Column) -> Column:
    """R2: of two version structs the one with the higher seq, a on a tie; the other where one is null."""
    return F.when(a.isNull() | (b["seq"] > a["seq"]), F.coalesce(b, a)).otherwise(a)


def size(log: DataFrame) -> DataFrame:
    """Number of live keys, one row."""
    return view(log).agg(F.count("*").alias("size"))


def next_seq(log: DataFrame) -> DataFrame:
    """One more than the highest seq; 1 for an empty log."""
    return log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def memtable(log: DataFrame, threshold: int = FLUSH_BYTES) -> DataFrame:
    """Entries, live entries and bytes of the resolved log, and whether it should be flushed."""
    total = F.coalesce(F.sum(entry_bytes(F.col("key"), F.col("value"))), F.lit(0))
    return newest(log).agg(F.count("*").alias("entries"), F.count_if(~F.col("tombstone")).alias("live"), total.alias("bytes"), (total >= threshold).alias("should_flush"))
