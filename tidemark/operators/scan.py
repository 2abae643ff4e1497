"""Scans of a (key, ...) relation: by prefix, by range, by lists of keys.

Filters are on the stored key column, so that they reach the files' statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import sort_key


def get(view: DataFrame, key: str) -> DataFrame:
    """The row of a key, or none."""
    return view.where(F.col("key") == key)


def exists(view: DataFrame, key: str) -> DataFrame:
    """One row."""
    return get(view, key).agg((F.count("*") > 0).alias("found"))


def prefix(view: DataFrame, start: str, order: str = "utf8") -> DataFrame:
    """Keys that begin so, ascending; the empty prefix is all."""
    found = view.where(F.col("key").startswith(start)) if start else view
    return found.orderBy(sort_key(F.col("key"), order))


def between(view: DataFrame, low: str = "", high: str = "", order: str = "utf8") -> DataFrame:
    """Keys from low (inclusive) to high (exclusive), ascending; an empty bound is open."""
    own = (lambda s: s.encode()) if order == "utf8" else (lambda s: s.encode("utf-16-be"))
    if low and high and own(low) >= own(high):
        raise ValueError(f"the lower bound {low!r} is not below {high!r}")
    key, found = sort_key(F.col("key"), order), view
    if low:
        found = found.where(key >= sort_key(F.lit(low), order))
    if high:
        found = found.where(key < sort_key(F.lit(high), order))
    return found.orderBy(key)


def count(view: DataFrame) -> DataFrame:
    return view.agg(F.count("*").alias("n"))


def keys_frame(spark: SparkSession, keys: list[str]) -> DataFrame:
    """A list of keys as (pos, key)."""
    return spark.createDataFrame(list(enumerate(keys)), "pos int, key string")


def mget(view: DataFrame, wanted: DataFrame) -> DataFrame:
    """B2: (pos, key, value) of the wanted (pos, key), each key once, at its first place; absent keys have a null value."""
    once = wanted.groupBy("key").agg(F.min("pos").alias("pos"))
    return once.join(view.select("key", "value"), "key", "left").select("pos", "key", "value").orderBy("pos")


def mexists(view: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row, true if every wanted key is there (also for none)."""
    return wanted.join(view, "key", "left_anti").agg((F.count("*") == 0).alias("all_exist"))


def count_distinct_present(view: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many keys a DEL of the wanted ones would remove: a second mention counts nothing."""
    return wanted.join(view, "key", "left_semi").agg(F.count_distinct("key").alias("deleted"))


def count_present(view: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many of the wanted mentions are present, duplicates counted."""
    return wanted.join(view.select("key"), "key").agg(F.count("*").alias("present"))


def multi_get(view: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pos, key, value) for every mention, in order, nulls for missing keys."""
    return wanted.join(view.select("key", "value"), "key", "left").select("pos", "key", "value").orderBy("pos")
