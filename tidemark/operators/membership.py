"""Members, failure detection by timeout, and gossip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.resolve import newest
from tidemark.plans.session import cut

STATUSES = ("STANDALONE", "JOINING", "ACTIVE", "SUSPECT", "DOWN", "LEAVING")
SUSPECT_MS, DOWN_MS, CHECK_MS, FANOUT = 3_000, 10_000, 1_000, 3


def members(events: DataFrame) -> DataFrame:
    """(node_id, status) after events (node_id, event, seq): join, leave, suspect, down; seq from 0.

    A join makes a node active, a leave removes it; suspect and down count only for a node that is known at that moment.
    """
    at = lambda e: F.coalesce(F.max(F.when(F.col("event") == e, F.col("seq"))), F.lit(-1))
    # After a node's last join, if it did not leave since, every event counts; so its last event says what it is.
    last = events.groupBy("node_id").agg(F.max_by("event", "seq").alias("event"), at("join").alias("_joined"), at("leave").alias("_left")).where(F.col("_joined") > F.col("_left"))
    status = F.when(F.col("event") == "join", "ACTIVE").when(F.col("event") == "suspect", "SUSPECT").otherwise("DOWN")
    return last.select("node_id", status.alias("status"))


def active(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("status") == "ACTIVE")


def status_counts(nodes: DataFrame) -> DataFrame:
    """Total and active, one row."""
    return nodes.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ACTIVE").alias("active"))


def since_heartbeat(tracked: DataFrame, heartbeats: DataFrame, as_of: int) -> DataFrame:
    """(node_id, elapsed_ms) of the tracked nodes; -1 for one never heard of."""
    last = heartbeats.groupBy("node_id").agg(F.max("ts").alias("_last"))
    return tracked.select("node_id").join(last, "node_id", "left").select("node_id", F.coalesce(F.lit(as_of) - F.col("_last"), F.lit(-1)).cast("long").alias("elapsed_ms"))


def classify(elapsed: Column, suspect_ms: int = SUSPECT_MS, down_ms: int = DOWN_MS) -> Column:
    """Status by time since the last heartbeat."""
    return F.when(elapsed >= down_ms, "DOWN").when(elapsed >= suspect_ms, "SUSPECT").otherwise("ACTIVE")


def detect(tracked: DataFrame, heartbeats: DataFrame, as_of: int, suspect_ms: int = SUSPECT_MS, down_ms: int = DOWN_MS) -> DataFrame:
    """(node_id, elapsed_ms, status)."""
    return since_heartbeat(tracked, heartbeats, as_of).withColumn("status", classify(F.col("elapsed_ms"), suspect_ms, down_ms))


def gossip_merge(local: DataFrame, digest: DataFrame) -> DataFrame:
    """(node_id, status, version) of two digests; the strictly higher version wins, local on a tie."""
    both = local.select("node_id", "status", "version", F.lit(0).alias("_rank")).unionByName(digest.select("node_id", "status", "version", F.lit(1).alias("_rank")))
    return newest(both, by="node_id", seq="version", rank="_rank").drop("_rank")


def gossip_updates(local: DataFrame, digest: DataFrame) -> DataFrame:
    """How many entries the merge changes, one row."""
    old = local.select("node_id", F.col("version").alias("_old"))
    best = digest.groupBy("node_id").agg(F.max("version").alias("version")).join(old, "node_id", "left")
    return best.agg(F.count_if(F.col("_old").isNull() | (F.col("version") > F.col("_old"))).alias("updated"))


def gossip_round(state: DataFrame, edges: DataFrame) -> DataFrame:
    """States (observer, node_id, status, version) after each observer has raised its own version and sent its digest along edges (src, dst).

    The edges are an argument (the random choice of peers is the caller's), so a round can be repeated.
    """
    raised = state.withColumn("version", F.col("version") + F.when(F.col("observer") == F.col("node_id"), 1).otherwise(0))
    sent = raised.join(edges, raised["observer"] == edges["src"]).select(F.col("dst").alias("observer"), "node_id", "status", "version", F.lit(1).alias("_rank"))
    both = raised.withColumn("_rank", F.lit(0)).unionByName(sent)
    return newest(both, by=["observer", "node_id"], seq="version", rank="_rank").drop("_rank")


def gossip(state: DataFrame, edges_by_round: list[DataFrame]) -> DataFrame:
    """Rounds of gossip; what each leaves is computed once."""
    for edges in edges_by_round:
        state = cut(gossip_round(state, edges))
    return state


def converged(state: DataFrame) -> DataFrame:
    """Whether all observers hold the same versions of the same nodes, one row."""
    by_node = state.groupBy("node_id").agg(F.count_distinct("version").alias("v"), F.count("*").alias("n"))
    return by_node.agg(((F.max("v") == 1) & (F.max("n") == F.min("n"))).alias("converged"))


def admin_reply(requests: DataFrame, bodies: DataFrame) -> DataFrame:
    """Requests (pos, method, path) with code and body, of bodies (path, body): 405 for other methods than GET, 404 for other paths."""
    held = requests.join(bodies.select("path", F.col("body").alias("_body")), "path", "left")
    code = F.when(F.upper("method") != "GET", 405).when(F.col("_body").isNull(), 404).otherwise(200)
    return held.select("pos", code.alias("code"), F.when(code == 200, F.col("_body")).alias("body"))


def seeds(env: DataFrame) -> DataFrame:
    """(node_id, host, port, status) of a comma-separated seeds column; malformed ones are left out."""
    one = env.select(F.explode(F.split("seeds", ",")).alias("s")).select(F.trim("s").alias("s"))
    parts = one.select("s", F.split("s", ":").alias("p")).where("size(p) = 2").select(F.col("p")[0].alias("host"), F.try_to_number(F.col("p")[1], F.lit("99999")).cast("int").alias("port"))
    return parts.where("port is not null and host <> ''").select(F.concat_ws(":", "host", F.col("port").cast("string")).alias("node_id"), "host", "port", F.lit("ACTIVE").alias("status"))


def health_json(nodes: DataFrame) -> DataFrame:
    """The health document, one row."""
    n = F.count_if(F.col("status") == "ACTIVE")
    return nodes.agg(F.to_json(F.struct(F.when(n > 0, "UP").otherwise("DEGRADED").alias("status"), n.alias("activeNodes"))).alias("body"))


def status_json(nodes: DataFrame) -> DataFrame:
    return status_counts(nodes).select(F.to_json(F.struct("total", "active")).alias("body"))


def nodes_json(nodes: DataFrame) -> DataFrame:
    """The active nodes (node_id, host, port, status), one row."""
    node = F.struct(F.col("node_id").alias("nodeId"), "host", "port", "status")
    return active(nodes).agg(F.to_json(F.array_sort(F.collect_list(node))).alias("body"))
