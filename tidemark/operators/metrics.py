"""Metrics as aggregates (R9, R10, I17): counters, gauges, cumulative histograms, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The upper bounds of the histogram's buckets; one without bound follows.
BOUNDS = (1, 5, 10, 50, 100, 500, 1000)


def counters(increments: DataFrame) -> DataFrame:
    """(name, value) of increments (name, delta)."""
    return increments.groupBy("name").agg(F.sum("delta").cast("long").alias("value"))


def gauges(settings: DataFrame) -> DataFrame:
    """(name, value) of settings (name, value, ts): the last."""
    return settings.groupBy("name").agg(F.max_by("value", F.struct("ts", "value")).cast("long").alias("value"))


def value_of(metrics: DataFrame, name: str) -> DataFrame:
    """The value of a name, 0 if it is unknown; one row."""
    return metrics.where(F.col("name") == name).agg(F.coalesce(F.max("value"), F.lit(0)).alias("value"))


def _bucket(bound: int | None) -> Column:
    return F.count_if(F.col("value_ms") <= bound) if bound is not None else F.count("value_ms")


def histogram_columns(observations: DataFrame) -> DataFrame:
    """R10 in one pass: (name, b_1, ..., b_inf, count, sum) of observations (name, value_ms)."""
    buckets = [_bucket(b).alias(f"b_{b}") for b in BOUNDS]
    total = F.coalesce(F.sum("value_ms"), F.lit(0)).cast("long")
    return observations.groupBy("name").agg(*buckets, _bucket(None).alias("b_inf"), F.count("value_ms").alias("count"), total.alias("sum"))


def histogram(observations: DataFrame) -> DataFrame:
    """(name, le, bucket) with le as text, "+Inf" last."""
    rows = F.array(*[F.struct(F.lit(str(b) if b else "+Inf").alias("le"), F.col(f"b_{b}" if b else "b_inf").alias("bucket")) for b in (*BOUNDS, None)])
    return histogram_columns(observations).select("name", F.explode(rows).alias("x")).select("name", "x.le", "x.bucket")


def scrape(counted: DataFrame, gauged: DataFrame, observations: DataFrame) -> DataFrame:
    """(kind, name, text) in the text exposition format, by kind (counter, gauge, histogram) and name."""
    simple = lambda df, kind: df.select(F.lit(kind).alias("kind"), "name", F.concat(F.lit("# TYPE "), "name", F.lit(f" {kind}\n"), "name", F.lit(" "), F.col("value").cast("string"), F.lit("\n")).alias("text"))
    lines = [F.concat(F.col("name"), F.lit(f'_bucket{{le="{b or "+Inf"}"}} '), F.col(f"b_{b}" if b else "b_inf").cast("string"), F.lit("\n")) for b in (*BOUNDS, None)]
    tail = [F.concat(F.col("name"), F.lit(f"_{c} "), F.col(c).cast("string"), F.lit("\n")) for c in ("count", "sum")]
    whole = F.concat(F.lit("# TYPE "), "name", F.lit(" histogram\n"), *lines, *tail)
    histograms = histogram_columns(observations).select(F.lit("histogram").alias("kind"), "name", whole.alias("text"))
    return simple(counted, "counter").unionByName(simple(gauged, "gauge")).unionByName(histograms)


def scrape_text(scraped: DataFrame) -> DataFrame:
    """The whole document, one row."""
    ordered = F.array_sort(F.collect_list(F.struct("kind", "name", "text")))
    return scraped.agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("body"))
