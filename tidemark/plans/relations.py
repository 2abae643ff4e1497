"""The driver's tables as key-value relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
RUNS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts):
    """Milliseconds of a timestamp without zone, taken as UTC."""
    return F.expr(f"unix_micros(cast({ts} as timestamp)) div 1000")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations(table(spark, sf_dir, "events"))


def mutations(events: DataFrame) -> DataFrame:
    """Mutations of user keys from events: errors delete; every third has no deadline; four runs."""
    gone = F.col("event_type") == "error"
    return events.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.when(~gone, F.concat_ws("|", "event_type", "props")).alias("value"),
        (F.col("event_id") + 1).alias("seq"),
        gone.alias("tombstone"),
        F.when((F.col("event_id") + 1) % 3 != 0, millis("ts") + DAY_MS).alias("expire_at"),
        (F.col("event_id") % RUNS).cast("int").alias("run"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static view of orders."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderstatus").alias("value"))


def nodes(spark: SparkSession, n: int, first: int = 1) -> DataFrame:
    return spark.range(first, first + n, 1, 1).select(F.concat(F.lit("node"), F.col("id").cast("string")).alias("node_id"))


def replica_state(mutations: DataFrame, n: int = 3) -> DataFrame:
    """Versions that replicas node1 to node<n> hold: the i-th (from 0) misses those whose seq leaves i when divided by 5."""
    held = mutations.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.col("seq") % 5 != F.col("i"))
    return held.select(F.concat(F.lit("node"), (F.col("i") + 1).cast("string")).alias("node_id"), "key", "value", "seq", "tombstone")


# The same relations for the independent engine.
LOG_SQL = """log AS (SELECT 'user:' || lpad(user_id::VARCHAR, 6, '0') AS key, event_id + 1 AS seq, event_type = 'error' AS tombstone,
       CASE WHEN event_type <> 'error' THEN event_type || '|' || props END AS value,
       CASE WHEN (event_id + 1) % 3 <> 0 THEN epoch_us(ts) // 1000 + 86400000 END AS expire_at, (event_id % 4)::INTEGER AS run FROM events)"""
STATE_SQL = LOG_SQL + """,
state AS (SELECT key, max(seq) AS seq, arg_max(tombstone, seq) AS tombstone, max_by(CASE WHEN value IS NULL THEN '' ELSE value END, seq) AS v,
                 max_by(coalesce(expire_at, -1), seq) AS e FROM log GROUP BY key),
resolved AS (SELECT key, CASE WHEN NOT tombstone THEN v END AS value, seq, tombstone, CASE WHEN e >= 0 THEN e END AS expire_at FROM state),
view AS (SELECT key, value FROM resolved WHERE NOT tombstone)"""
ORDERS_SQL = "orders_kv AS (SELECT 'order:' || o_orderkey::VARCHAR AS key, o_orderstatus AS value FROM orders)"
TOKEN = "(('0x' || substring(md5({0}), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT"


def ring_sql(name: str, n: int, vnodes: int = 150) -> str:
    label = "'node' || i || '#vn' || v"
    return f"{name} AS (SELECT {TOKEN.format(label)} AS token, 'node' || i AS node_id FROM range(1, {n + 1}) a(i), range({vnodes}) b(v))"


def primary_sql(keys: str, ring: str) -> str:
    """A subquery (key, node_id)."""
    return f"(SELECT h.key, coalesce(r.node_id, (SELECT arg_min(node_id, token) FROM {ring})) AS node_id FROM (SELECT key, {TOKEN.format('key')} AS t FROM {keys}) h ASOF LEFT JOIN {ring} r ON h.t <= r.token)"


STATES_SQL = STATE_SQL + """,
replicas AS (SELECT 'node' || (i + 1) AS node_id, key, value, seq, tombstone, i FROM log, range(3) t(i) WHERE seq % 5 <> i),
held AS (SELECT node_id, key, max(seq) AS seq FROM replicas GROUP BY node_id, key)"""
