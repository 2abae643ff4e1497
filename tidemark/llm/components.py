"""Connected components of a distributed edge list, by alternating star steps.

Each round hangs every node's larger neighbours below its least neighbour (large star), then every node below its
least smaller neighbour (small star); the edges end as stars around the least node of each component. Minima
are summed up before they are shuffled, and joins are between plain exchanges, so that Spark can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.session import cut


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
    return r.n, r.h


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) edges, a and b long; returns (node, root) for every node that isn't its component's least."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = cut(large.distinct())
        small = large.join(_least(large), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        if (new := _state(now)) == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
