"""Replicated logs as relations (F1 to F7, F9, R8, R12, R13): rows (node_id, index, term, cmd, key, value), index from 1.

The relational part of consensus only: log surgery, rounds of replication over the nodes that are reached, votes, elections that are due, who may write, the commit index and the fold. Time is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.order import numbered, with_last_before
from tidemark.operators.resolve import newest


# The bounds of election timeouts.
LEAST_TIMEOUT_MS, MOST_TIMEOUT_MS = 150, 300


def tail(logs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, last_index, last_term) of nodes; 0 and 0 for an empty log."""
    last = logs.groupBy("node_id").agg(F.max("index").alias("i"), F.max_by("term", "index").alias("t"))
    return nodes.select("node_id").join(last, "node_id", "left").select("node_id", F.coalesce("i", F.lit(0)).cast("long").alias("last_index"), F.coalesce("t", F.lit(0)).cast("long").alias("last_term"))


def gaps(logs: DataFrame) -> DataFrame:
    """entries that don't follow the one before (every log begins at 1)."""
    placed = with_last_before(logs, "node_id", "index", F.col("index"), "_before")
    return placed.where(F.col("index") != F.coalesce("_before", F.lit(0)) + 1).drop("_before")


def truncated(logs: DataFrame, first_dropped: int) -> DataFrame:
    """without the suffix from an index on."""
    if first_dropped <= 0:
        raise ValueError("the sentinel can't be dropped")
    return logs.where(F.col("index") < first_dropped)


def part(logs: DataFrame, first: int, end: int) -> DataFrame:
    """Entries from first to end, exclusive."""
    return logs.where((F.col("index") >= max(1, first)) & (F.col("index") < end))


def contains(logs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (node_id, index, term) with found; index 0 is in every log."""
    held = logs.select("node_id", "index", "term", F.lit(True).alias("_f"))
    return wanted.join(held, ["node_id", "index", "term"], "left").select("node_id", "index", "term", ((F.col("index") == 0) | F.coalesce("_f", F.lit(False))).alias("found"))


def at_least_as_new(term: Column, index: Column, own_term: Column, own_index: Column) -> Column:
    """whether a candidate's log (term, index) is up to date for a voter's."""
    return F.struct(term.cast("long"), index.cast("long")) >= F.struct(own_term.cast("long"), own_index.cast("long"))


def votes(requests: DataFrame, voters: DataFrame) -> DataFrame:
    """requests (pos, voter, candidate, term, last_index, last_term) with granted; voters: (voter, term, last_index, last_term) before.

    A voter grants in order of pos what is not below any term it has seen, to one candidate per term, if that one's log is up to date.
    """
    own = voters.select("voter", F.col("term").alias("_term"), F.col("last_index").alias("_index"), F.col("last_term").alias("_last"))
    seen = F.greatest("_term", F.coalesce(F.max("term").over(W.partitionBy("voter").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    fit = (F.col("term") >= F.col("_seen")) & at_least_as_new(F.col("last_term"), F.col("last_index"), F.col("_last"), F.col("_index"))
    judged = requests.join(own, "voter").withColumn("_seen", seen).withColumn("_fit", fit)
    first = F.first(F.when(F.col("_fit"), F.col("candidate")), ignorenulls=True).over(W.partitionBy("voter", "term").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return judged.withColumn("granted", F.col("_fit") & (F.col("candidate") == first)).select("pos", "voter", "candidate", "term", "granted")


def timeout_ms(node_id: Column, term: Column) -> Column:
    """how long a node waits for its leader in a term: drawn by a hash of both, so that nodes differ and a rerun agrees."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("#", node_id, term.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.lit(LEAST_TIMEOUT_MS) + drawn % (MOST_TIMEOUT_MS - LEAST_TIMEOUT_MS)


def elections_due(nodes: DataFrame, as_of: int) -> DataFrame:
    """(candidate, term) of the elections that begin by a time: nodes (node_id, role, term, heard) that don't lead and have heard nothing for
    their timeout, each in the term after its own."""
    late = F.lit(as_of) - F.col("heard") >= timeout_ms(F.col("node_id"), F.col("term"))
    return nodes.where((F.col("role") != "LEADER") & late).select(F.col("node_id").alias("candidate"), (F.col("term") + 1).alias("term"))


def stepped_down(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """nodes (node_id, role, term) after messages (node_id, term): whoever meets a higher term follows in it, the others stay as they are."""
    seen = messages.groupBy("node_id").agg(F.max("term").alias("_seen"))
    higher = F.col("_seen") > F.col("term")
    return nodes.join(seen, "node_id", "left").select("node_id", F.when(higher, "FOLLOWER").otherwise(F.col("role")).alias("role"), F.when(higher, F.col("_seen")).otherwise(F.col("term")).alias("term"))


def admitted(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """requests (pos, node_id, op) with status and leader: any node answers reads, only a leader takes writes; others name the leader of the highest term."""
    leader = nodes.where(F.col("role") == "LEADER").agg(F.max_by("node_id", "term").alias("leader"))  # one row, null where none leads
    judged = requests.join(nodes.select("node_id", "role"), "node_id", "left").join(leader, F.lit(True))
    reads, leads = F.col("op").isin("GET", "EXISTS"), F.coalesce(F.col("role") == "LEADER", F.lit(False))
    status = F.when(F.col("role").isNull(), "UNKNOWN_NODE").when(reads | leads, "OK").otherwise("NOT_LEADER")
    return judged.select("pos", status.alias("status"), F.when(status == "NOT_LEADER", F.col("leader")).alias("leader"))


def reached(edges: DataFrame, source: str, cut_off: DataFrame | None = None) -> DataFrame:
    """(node_id) that a node's messages get to over edges (src, dst), less those (src, dst) that a partition cuts."""
    left = edges.join(cut_off, ["src", "dst"], "left_anti") if cut_off is not None else edges
    return left.where(F.col("src") == source).select(F.col("dst").alias("node_id")).distinct()


def elected(granted: DataFrame, cluster: int) -> DataFrame:
    """(term, candidate, votes) of candidates with a majority of the cluster."""
    counted = granted.where("granted").groupBy("term", "candidate").agg(F.count_distinct("voter").alias("votes"))
    return counted.where(F.col("votes") >= cluster // 2 + 1)


def appended(follower: DataFrame, leader: DataFrame, prev_index: int, prev_term: int) -> DataFrame:
    """the follower's log (index, term, cmd, key, value) after the leader's entries above prev_index.

    Nothing changes where the follower lacks the entry before; else it is cut at the first entry whose term differs, and the leader's
    entries follow. Entries past the leader's last stay if nothing before them differs.
    """
    columns = ["index", "term", "cmd", "key", "value"]
    matches = follower.where((F.col("index") == prev_index) & (F.col("term") == prev_term)).agg((F.lit(prev_index == 0) | (F.count("*") > 0)).alias("_ok"))
    new = leader.where(F.col("index") > prev_index)
    conflict = follower.select("index", "term").join(new.select("index", F.col("term").alias("_t")), "index").where(F.col("term") != F.col("_t")).agg(F.min("index").alias("_conflict"))
    kept = follower.select(columns).join(conflict, F.lit(True)).join(matches, F.lit(True)).where(~F.col("_ok") | F.col("_conflict").isNull() | (F.col("index") < F.col("_conflict"))).select(columns)
    added = new.select(columns).join(matches, F.lit(True)).where("_ok").select(columns).join(kept.select("index"), "index", "left_anti").select(columns)
    return kept.unionByName(added)


def proposed(log: DataFrame, commands: DataFrame, term: int) -> DataFrame:
    """F8: the leader's log after commands (pos, cmd, key, value), in order of pos, as entries of its term at its end."""
    last = log.agg(F.coalesce(F.max("index"), F.lit(0)).alias("_last"))
    entries = numbered(commands, "pos", "_n", first=1).join(last, F.lit(True))  # one row
    return log.select("index", "term", "cmd", "key", "value").unionByName(entries.select((F.col("_n") + F.col("_last")).alias("index"), F.lit(term).cast("long").alias("term"), "cmd", "key", "value"))


def replicated(logs: DataFrame, leader: str, reached: DataFrame) -> DataFrame:
    """F8: the logs (node_id, index, term, cmd, key, value) of all nodes after a round in which the leader's entries get to the nodes of reached
    (node_id), each back to where they agree. Other nodes keep theirs.

    A follower's log is cut at its first entry of another term than the leader's; what it has past the leader's last stays if none differs.
    """
    columns = ["node_id", "index", "term", "cmd", "key", "value"]
    own = logs.where(F.col("node_id") == leader).drop("node_id")
    targets = reached.select("node_id").where(F.col("node_id") != leader).distinct()
    behind = logs.join(targets, "node_id", "left_semi")
    conflicts = behind.select("node_id", "index", "term").join(own.select("index", F.col("term").alias("_t")), "index").where(F.col("term") != F.col("_t")).groupBy("node_id").agg(F.min("index").alias("_conflict"))
    kept = behind.join(conflicts, "node_id", "left").where(F.col("_conflict").isNull() | (F.col("index") < F.col("_conflict"))).select(columns)
    sent = targets.join(own, F.lit(True)).select(columns)  # the entries that go out, once for each node
    added = sent.join(kept.select("node_id", "index"), ["node_id", "index"], "left_anti")
    return logs.join(targets, "node_id", "left_anti").select(columns).unionByName(kept).unionByName(added)


def matched(logs: DataFrame, leader: str) -> DataFrame:
    """(node_id, match_index) of each node with entries: how far its log agrees with the leader's from the start."""
    own = logs.where(F.col("node_id") == leader).select("index", F.col("term").alias("_t"))
    beside = logs.select("node_id", "index", "term").join(own, "index", "left")
    differs = F.col("_t").isNull() | (F.col("_t") != F.col("term"))
    ends = beside.groupBy("node_id").agg(F.min(F.when(differs, F.col("index"))).alias("_off"), F.max("index").alias("_last"))
    return ends.select("node_id", F.coalesce(F.col("_off") - 1, F.col("_last")).alias("match_index"))


def commit_index(matches: DataFrame, leader: DataFrame, term: int, committed: int = 0) -> DataFrame:
    """The highest index that a majority of matches (node_id, match_index; the leader included) has reached and whose entry in the
    leader's log is of the current term; else committed. One row."""
    n = F.count("*").over(W.partitionBy())
    ranked = matches.withColumn("_r", F.row_number().over(W.orderBy(F.col("match_index").desc()))).withColumn("_n", n)
    reached = ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).agg(F.max("match_index").alias("_m"))
    own = leader.where(F.col("term") == term).join(reached, F.col("index") <= F.col("_m"))
    return own.agg(F.greatest(F.coalesce(F.max("index"), F.lit(0)), F.lit(committed)).cast("long").alias("commit_index"))


def fold(log: DataFrame, commit: int) -> DataFrame:
    """The (key, value) state of the committed entries, each applied once in order of index."""
    done = log.where((F.col("index") <= commit) & (F.col("cmd") != "NoOp"))
    return newest(done.select("key", "value", "cmd", "index"), seq="index").where(F.col("cmd") == "Put").select("key", "value")
