"""Continuously kept views (S12, T5, G6, Q7) with Structured Streaming. The batch operators give the same results on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.membership import DOWN_MS, SUSPECT_MS, classify
from tidemark.operators.resolve import newest
from tidemark.sources.lake import Lake


def latest(log: DataFrame) -> DataFrame:
    """R1 over a stream of mutations: one state row per key. Late rows with a lower seq change nothing, so no watermark is needed."""
    kept = [c for c in log.columns if c not in ("key", "seq")]
    return log.groupBy("key").agg(F.max_by(F.struct(*kept, "seq"), "seq").alias("w")).select("key", *[F.col("w")[c].alias(c) for c in [*kept, "seq"]])


def to_memory(view: DataFrame, name: str, checkpoint: str) -> DataStreamWriter:
    """A small view (a status page, a test) as a table on the driver; see into_folder for any other."""
    return view.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def into_folder(view: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Writes the rows of an aggregated view that each micro-batch changes, as Parquet under the batch's number; a batch done again is written over."""

    def commit(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/_at={batch}")

    return view.writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def from_folder(spark: SparkSession, folder: str, by: str = "key") -> DataFrame:
    """The view that into_folder keeps: of each key the row of the last batch that changed it."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/_at=*").withColumn("_at", F.col("_at").cast("long"))
    return newest(rows, by=by, seq="_at").drop("_at")


def into_lake(mutations: DataFrame, lake: Lake, checkpoint: str) -> DataStreamWriter:
    """Appends each micro-batch of mutations to a lake. A batch that is done again after a failure changes nothing: equal seq, equal rows."""

    def commit(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            lake.append(rows)

    return mutations.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def deliver_hints(hints: DataFrame, members: DataFrame, lakes: dict[str, Lake], checkpoint: str) -> DataStreamWriter:
    """Q7: each micro-batch of hints goes to the lakes of its active targets."""

    def commit(rows: DataFrame, batch: int) -> None:
        up = [r.node_id for r in members.where(F.col("status") == "ACTIVE").collect()]
        for node in up:
            own = rows.where(F.col("target") == node)
            if node in lakes and not own.isEmpty():
                lakes[node].append(own.select("key", "value", "seq", (F.col("op") == "DELETE").alias("tombstone")))

    return hints.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def heartbeat_status(heartbeats: DataFrame, as_of: int, suspect_ms: int = SUSPECT_MS, down_ms: int = DOWN_MS) -> DataFrame:
    """G6 over a stream of heartbeats (node_id, ts): status at a given time."""
    elapsed = F.lit(as_of) - F.col("last")
    return heartbeats.groupBy("node_id").agg(F.max("ts").alias("last")).select("node_id", elapsed.cast("long").alias("elapsed_ms"), classify(elapsed, suspect_ms, down_ms).alias("status"))


def heartbeat_gaps(heartbeats: DataFrame, at: str = "at", lateness: str = "10 seconds", gap_ms: int = DOWN_MS) -> DataFrame:
    """Sessions of each node by event time: a node that is silent for gap_ms ends its session, which is given out when the watermark passes it."""
    sessions = heartbeats.withWatermark(at, lateness).groupBy("node_id", F.session_window(at, f"{gap_ms} milliseconds").alias("s"))
    return sessions.agg(F.count("*").alias("beats")).select("node_id", F.col("s.start").alias("since"), F.col("s.end").alias("down_at"), "beats")


def mutation_rates(mutations: DataFrame, at: str = "at", lateness: str = "1 minute", width: str = "1 minute") -> DataFrame:
    """Writes and deletions in windows of event time, within the watermark."""
    windows = mutations.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"))
    return windows.agg(F.count_if(~F.col("tombstone")).alias("writes"), F.count_if("tombstone").alias("deletes")).select(F.col("w.start").alias("since"), "writes", "deletes")


def expiring(mutations: DataFrame, as_of: int) -> DataFrame:
    """T5 over a stream: keys whose newest entry is live and past its deadline at a given time."""
    return latest(mutations).where(~F.col("tombstone") & (F.col("expire_at") <= as_of)).select("key", "seq", "expire_at")
