"""Order-dependent relations without sorting everything, or all of a hot key, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.session import cut

SPAN = 65_536


def numbered(df: DataFrame, by: str, name: str, first: int = 0) -> DataFrame:
    """df with the place of each row in the order of a column, from first: ranges are sorted apart, and each begins at the count of those before."""
    ranged = cut(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()))  # read twice: the ranges must be the same
    before = F.sum("count").over(W.orderBy("_range")) - F.col("count")
    starts = ranged.groupBy("_range").count().select("_range", before.alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(by)) - 1 + F.col("_before") + first
    return ranged.join(starts, "_range").withColumn(name, place.cast("long")).drop("_range", "_before")


def with_last_before(df: DataFrame, key: str, position: str, write: Column, name: str, then: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """df with the last non-null write to the row's key at an earlier place, in the order of position (an integer) and then of more columns.

    A key's rows are cut into spans of positions: what a span leaves is an aggregate, what it finds is a window over the spans, and only within
    a span are rows looked at one by one. So a key with a third of all rows is many tasks' work.
    """
    spans = df.withColumn("_write", write).withColumn("_span", F.floor(F.col(position) / span))
    order = F.struct(position, *then)
    left = spans.groupBy(key, "_span").agg(F.max_by("_write", F.when(F.col("_write").isNotNull(), order)).alias("_left"))
    found = left.select(key, "_span", F.last("_left", ignorenulls=True).over(W.partitionBy(key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)).alias("_found"))
    inside = F.last("_write", ignorenulls=True).over(W.partitionBy(key, "_span").orderBy(position, *then).rowsBetween(W.unboundedPreceding, -1))
    joined = spans.withColumn("_inside", inside).join(found.withColumnRenamed(key, "_key").withColumnRenamed("_span", "_of"), (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_span") == F.col("_of")), "left")
    return joined.withColumn(name, F.coalesce("_inside", "_found")).drop("_write", "_span", "_inside", "_key", "_of", "_found")
