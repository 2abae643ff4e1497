"""Time to live: deadlines as a column, and the time always as an argument.

An entry is visible while as_of is before its deadline; a null deadline never comes. A later mutation carries its own deadline or
none, so a plain put or a deletion clears it by being newer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERSISTENT, ABSENT = -1, -2


def deadline(now_ms: int, ttl_ms: int) -> int:
    """T1."""
    if ttl_ms <= 0:
        raise ValueError("a time to live must be positive")
    return now_ms + ttl_ms


def is_visible(as_of: int) -> Column:
    return F.col("expire_at").isNull() | (F.col("expire_at") > as_of)


def visible(entries: DataFrame, as_of: int) -> DataFrame:
    """Resolved live entries whose deadline has not come."""
    return entries.where(is_visible(as_of))


def expired(entries: DataFrame, as_of: int) -> DataFrame:
    """T5: resolved live entries to be evicted."""
    return entries.where(~is_visible(as_of))


def ttl(entries: DataFrame, wanted: DataFrame, as_of: int) -> DataFrame:
    """T4: (key, ttl_ms) of the wanted keys: what is left, -1 without deadline, -2 if absent or expired."""
    held = entries.select("key", F.lit(True).alias("_held"), "expire_at")
    left = F.when(F.col("_held").isNull() | ~is_visible(as_of), ABSENT).when(F.col("expire_at").isNull(), PERSISTENT).otherwise(F.col("expire_at") - as_of)
    return wanted.select("key").join(held, "key", "left").select("key", left.cast("long").alias("ttl_ms"))


def counts(entries: DataFrame, as_of: int) -> DataFrame:
    """Visible and expired entries, one row; only visible ones count as held."""
    return entries.agg(F.count_if(is_visible(as_of)).alias("visible"), F.count_if(~is_visible(as_of)).alias("expired"))


def evictions(entries: DataFrame, as_of: int) -> DataFrame:
    """T5: tombstones one seq above the entries they evict."""
    return expired(entries, as_of).select("key", F.lit(None).cast("string").alias("value"), (F.col("seq") + 1).alias("seq"), F.lit(True).alias("tombstone"), F.lit(None).cast("long").alias("expire_at"))
