"""Quorum reads and writes, read repair and hinted delivery as relations.

Placement is (key, replica_pos, node_id); replica state is (node_id, key, value, seq, tombstone), a row for each version that a replica holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.resolve import newest


@dataclass(frozen=True)
class Quorum:
    """Q4: replicas, acknowledgements for a write, answers for a read."""

    n: int = 3
    w: int = 2
    r: int = 2

    def __post_init__(self):
        if self.n < 1 or not 1 <= self.w <= self.n or not 1 <= self.r <= self.n:
            raise ValueError(f"w and r must be between 1 and n: {self}")

    @property
    def strong(self) -> bool:
        return self.r + self.w > self.n


def acks(placement: DataFrame, up: DataFrame, quorum: Quorum) -> DataFrame:
    """Q1, Q3: (key, acks, ok) of a write (put or tombstone) sent to every replica in placement; up (node_id) has those that answer."""
    answering = placement.join(up.select("node_id", F.lit(True).alias("_up")), "node_id", "left")
    counted = answering.groupBy("key").agg(F.count_if(F.col("_up")).alias("acks"))
    return counted.withColumn("ok", F.col("acks") >= quorum.w)


def read(placement: DataFrame, up: DataFrame, state: DataFrame, quorum: Quorum, first_present: bool = False) -> DataFrame:
    """Q2: (key, value, seq) from the first r answering replicas in ring order; keys with fewer answers have no row.

    The newest version among them wins and a tombstone hides the key. first_present: the first replica in ring order that has a live
    version wins instead.
    """
    answering = placement.join(up.select("node_id"), "node_id", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("replica_pos", "node_id"))).alias("_a"))
    asked = answering.where(F.size("_a") >= quorum.r).select("key", F.explode(F.slice("_a", 1, quorum.r)).alias("_a")).select("key", "_a.node_id", "_a.replica_pos")
    if first_present:
        present = asked.join(state.where(~F.col("tombstone")), ["key", "node_id"])
        return present.groupBy("key").agg(F.min_by(F.struct("value", "seq"), F.struct("replica_pos", -F.col("seq"))).alias("w")).select("key", "w.value", "w.seq")
    held = newest(state.select("key", "node_id", "value", "seq", "tombstone"), by=["key", "node_id"])  # a version each, before anything is joined
    answers = asked.join(held, ["key", "node_id"]).select("key", "replica_pos", "value", "seq", "tombstone")
    return newest(answers, rank="replica_pos").where(~F.col("tombstone")).select("key", "value", "seq")


def winners(state: DataFrame) -> DataFrame:
    """The newest version of each key over all replicas; on a tie that of the least node_id."""
    version, order = F.struct("value", "seq", "tombstone"), F.struct(-F.col("seq"), "node_id")
    return state.groupBy("key").agg(F.min_by(version, order).alias("w")).select("key", "w.value", "w.seq", "w.tombstone")


def repairs(placement: DataFrame, state: DataFrame) -> DataFrame:
    """Q5: (node_id, key, value, seq, tombstone) to write: the winner, to each replica that lacks it or has an older version.

    Keys that no replica has need no repair; nodes outside the placement are left alone.
    """
    own = placement.select("key", "node_id").join(state.select("key", "node_id", "value", "seq", "tombstone"), ["key", "node_id"], "left")
    # A key has as many rows as replicas, so that its winner is found where they are.
    won = F.min_by(F.when(F.col("seq").isNotNull(), F.struct("value", "seq", "tombstone")), F.when(F.col("seq").isNotNull(), F.struct(-F.col("seq"), "node_id"))).over(W.partitionBy("key"))
    lacking = own.withColumn("_won", won).where(F.col("_won").isNotNull() & (F.col("seq").isNull() | (F.col("seq") < F.col("_won.seq"))))
    return lacking.select("node_id", "key", "_won.value", "_won.seq", "_won.tombstone")


def repaired(placement: DataFrame, state: DataFrame) -> DataFrame:
    """Q5: the replicas' state after the repairs."""
    return newest(state.select("node_id", "key", "value", "seq", "tombstone").unionByName(repairs(placement, state)), by=["node_id", "key"])


def hints(placement: DataFrame, up: DataFrame, mutations: DataFrame) -> DataFrame:
    """Q6: (target, op, key, value, seq) for each mutation and each of its replicas that does not answer."""
    missed = placement.join(up, "node_id", "left_anti").select("key", F.col("node_id").alias("target"))
    op = F.when(F.col("tombstone"), "DELETE").otherwise("PUT")
    return mutations.join(missed, "key").select("target", op.alias("op"), "key", "value", "seq")


def pending(all_hints: DataFrame) -> DataFrame:
    """Hints by target."""
    return all_hints.groupBy("target").agg(F.count("*").alias("pending"))


def total_pending(all_hints: DataFrame) -> DataFrame:
    return all_hints.agg(F.count("*").alias("pending"))


def fresh(all_hints: DataFrame, as_of: int, ttl_ms: int = 3 * 3600 * 1000) -> DataFrame:
    """Hints (with hint_ts) that are not too old to be delivered."""
    return all_hints.where(F.col("hint_ts") > as_of - ttl_ms)


def deliverable(all_hints: DataFrame, members: DataFrame) -> DataFrame:
    """Q7: hints whose target is active among members (node_id, status)."""
    active = members.where(F.col("status") == "ACTIVE").select(F.col("node_id").alias("target"))
    return all_hints.join(active, "target", "left_semi")


def remaining(all_hints: DataFrame, members: DataFrame) -> DataFrame:
    """Q7: hints that wait on."""
    active = members.where(F.col("status") == "ACTIVE").select(F.col("node_id").alias("target"))
    return all_hints.join(active, "target", "left_anti")


def replayed(state: DataFrame, all_hints: DataFrame, members: DataFrame) -> DataFrame:
    """Q7: the replicas' state after delivery, by seq: an old hint does not undo a newer write."""
    sent = deliverable(all_hints, members).select(F.col("target").alias("node_id"), "key", "value", "seq", (F.col("op") == "DELETE").alias("tombstone"))
    return newest(state.select("node_id", "key", "value", "seq", "tombstone").unionByName(sent), by=["node_id", "key"])
