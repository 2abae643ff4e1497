"""Consistent-hash placement as interval joins.

A ring is a relation (token, node_id). A key belongs to the first token at or after its own, around the end of the number line. The
intervals between tokens are cut at the borders of equal buckets of the line, so that finding a key's interval is an equality join on the bucket
with a range left over: a hash join with the small side broadcast by its known size, or a shuffled one for a huge ring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.hashing import TOKEN_MASK, ring_token
from tidemark.plans.session import cut

VNODES = 150
AHEAD = 8
BUCKET_BITS = 16  # a bucket has an arc or two of rings up to some hundreds of nodes; far larger rings want a few more


def tokens(nodes: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """(token, node_id) of nodes (node_id), each once; where two labels meet, the greater node_id stays."""
    labels = nodes.select("node_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))))
    return labels.select(ring_token(F.concat("node_id", F.lit("#vn"), F.col("i").cast("string"))).alias("token"), "node_id").groupBy("token").agg(F.max("node_id").alias("node_id"))


def without(ring: DataFrame, node_id: str) -> DataFrame:
    """P3."""
    return ring.where(F.col("node_id") != node_id)


def summary(ring: DataFrame) -> DataFrame:
    """Tokens of each node."""
    return ring.groupBy("node_id").agg(F.count("*").alias("tokens"))


def intervals(ring: DataFrame, carry: str = "node_id") -> DataFrame:
    """(low, high, carry): the keys' tokens above low and up to high belong to carry; with the arc around the end as a row of its own."""
    by = W.orderBy("token")
    ends = ring.select("token", carry, F.lag("token").over(by).alias("before"), F.max("token").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("last"))
    arc = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))
    first = F.array(arc(F.lit(-1), F.col("token")), arc(F.col("last"), F.lit(TOKEN_MASK)))
    arcs = F.when(F.col("before").isNull(), first).otherwise(F.array(arc(F.col("before"), F.col("token"))))
    return ends.select(F.explode(arcs).alias("arc"), carry).select("arc.*", carry).where("low < high")


def place(keys: DataFrame, ring: DataFrame, carry: str = "node_id", bits: int = BUCKET_BITS) -> DataFrame:
    """keys (key, others) with carry of the interval that each key's token is in. bits: as many buckets of the line as two to their power."""
    shift = 63 - bits
    cut = intervals(ring, carry).withColumn("_bucket", F.explode(F.sequence(F.shiftright(F.col("low") + 1, shift), F.shiftright(F.col("high"), shift))))
    hashed = keys.withColumn("_token", ring_token(F.col("key"))).withColumn("_bucket", F.shiftright("_token", shift))
    inside = (F.col("_token") > F.col("_low")) & (F.col("_token") <= F.col("_high"))
    arcs = cut.select(F.col("low").alias("_low"), F.col("high").alias("_high"), F.col(carry).alias("_carry"), "_bucket")
    return hashed.join(arcs, "_bucket").where(inside).select(*keys.columns, F.col("_carry").alias(carry))


def primary(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """Keys with node_id, their primary; no rows for an empty ring."""
    return place(keys, ring)


def replica_lists(ring: DataFrame, n: int) -> DataFrame:
    """(token, replicas): for each token the first n distinct nodes from there on, around the ring.

    Each token looks AHEAD tokens on for each replica; the few that find too few nodes there look four times as far, until all are found or
    have been around the ring. So the work goes with the tokens, not with tokens times nodes.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    placed = cut(ring.select("token", "node_id", (F.row_number().over(W.orderBy("token")) - 1).cast("long").alias("i"), F.count("*").over(W.partitionBy()).alias("all")))
    far, todo, done = AHEAD * n, placed, None
    while True:
        steps = todo.select("token", "all", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.lit(far), F.col("all")) - 1), lambda k: (F.col("i") + k) % F.col("all"))).alias("step", "i"))
        met = steps.join(placed.select("i", "node_id"), "i").groupBy("token", "all", "node_id").agg(F.min("step").alias("step"))
        found = met.groupBy("token", "all").agg(F.array_sort(F.collect_list(F.struct("step", "node_id"))).alias("w"))
        found = cut(found.select("token", "all", F.transform(F.slice("w", 1, n), lambda x: x["node_id"]).alias("replicas")))
        enough = (F.size("replicas") >= n) | (F.col("all") <= far)
        kept = found.where(enough).select("token", "replicas")
        done, todo = kept if done is None else done.unionByName(kept), placed.join(found.where(~enough).select("token"), "token", "left_semi")
        if todo.isEmpty():
            return done
        far *= 4


def replicas(keys: DataFrame, ring: DataFrame, n: int) -> DataFrame:
    """P5: keys with replicas, the first n distinct nodes clockwise; fewer on a small ring.

    The lists (a row for each token) are kept in the shared folder, as whatever uses the placement tends to use it several times.
    """
    return place(keys, replica_lists(ring, n), "replicas")


def replica_rows(keys: DataFrame, ring: DataFrame, n: int) -> DataFrame:
    """P5 as rows: keys with replica_pos from 0 and node_id."""
    return replicas(keys, ring, n).select(*keys.columns, F.posexplode("replicas").alias("replica_pos", "node_id"))


def moves_on_join(stores: DataFrame, ring_after: DataFrame, joiner: str) -> DataFrame:
    """Rows of stores (node_id, key, value) to copy to the joiner: keys it is now the primary of, held by others."""
    held = stores.where(F.col("node_id") != joiner).withColumnRenamed("node_id", "source")
    return place(held, ring_after).where(F.col("node_id") == joiner).select("key", "value", "source", F.col("node_id").alias("target"))


def moves_on_leave(stores: DataFrame, ring_after: DataFrame, departed: str) -> DataFrame:
    """Rows of the departed node, each to its new primary."""
    held = stores.where(F.col("node_id") == departed).withColumnRenamed("node_id", "source")
    return place(held, ring_after).select("key", "value", "source", F.col("node_id").alias("target"))


def remap_fraction(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys and the share of them whose primary changes, one row."""
    was = place(keys.select("key"), before).withColumnRenamed("node_id", "was")
    both = place(was, after)
    return both.agg(F.count("*").alias("keys"), F.count_if(F.col("was") != F.col("node_id")).alias("moved")).withColumn("fraction", F.try_divide("moved", "keys"))
