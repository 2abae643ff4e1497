"""Registry of the key-value queries: each operator applied to the driver's tables, and SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom, codecs, hashing, keys, resp
from tidemark.operators import batch, commands, membership, metrics, quorum, raftlog, resolve, ring, scan, ttl
from tidemark.operators.order import numbered, with_last_before
from tidemark.plans import relations as R
from tidemark.plans.session import scratch_path
from tidemark.sources import log as log_source
from tidemark.sources import files, runs, snapshot
from tidemark.sources.lake import Lake, read_snapshot
from tidemark.streaming import views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

AS_OF = 1_706_720_000_000  # about half of the deadlines of the newest versions have come
DETECT_AT, SUSPECT_MS, DOWN_MS = 1_706_700_000_000, 20_000_000, 100_000_000


def query(sql: str | None = None, with_: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"WITH {with_}\n{sql}" if with_ else sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys and bytes of each node of a ring of three: log, newest version, placement, sums."""
    view = resolve.view(R.log(spark, sf_dir))
    placed = ring.primary(view, ring.tokens(R.nodes(spark, 3)))
    return placed.groupBy("node_id").agg(F.count("*").alias("n_keys"), F.sum(keys.entry_bytes(F.col("key"), F.col("value"))).alias("bytes"))


def queries() -> dict[str, Query]:
    return {"kv_node_load": flagship, **_QUERIES}


def oracle_sql() -> dict[str, str]:
    load = f"WITH {R.STATE_SQL}, {R.ring_sql('ring', 3)} SELECT p.node_id, count(*) AS n_keys, sum(strlen(v.key) + strlen(v.value))::BIGINT AS bytes FROM view v JOIN {R.primary_sql('view', 'ring')} p USING (key) GROUP BY p.node_id"
    return {"kv_node_load": load, **_SQL}


# State, batches, scans (S, B, C, R)

@query("SELECT key, value, seq, tombstone, expire_at FROM resolved", R.STATE_SQL)
def kv_lww_state(spark, d):
    return resolve.newest(R.log(spark, d).drop("run"))


@query("SELECT key, value FROM view", R.STATE_SQL)
def kv_live_view(spark, d):
    return resolve.view(R.log(spark, d))


@query("SELECT count(*) AS size FROM view", R.STATE_SQL)
def kv_size(spark, d):
    return resolve.size(R.log(spark, d))


@query("SELECT key FROM view", R.STATE_SQL)
def kv_keys(spark, d):
    return resolve.view(R.log(spark, d)).select("key")


@query("SELECT key, value FROM view WHERE key = 'user:000042'", R.STATE_SQL)
def kv_get(spark, d):
    return scan.get(resolve.view(R.log(spark, d)), "user:000042")


@query("SELECT count(*) > 0 AS found FROM view WHERE key = 'user:000042'", R.STATE_SQL)
def kv_exists(spark, d):
    return scan.exists(resolve.view(R.log(spark, d)), "user:000042")


@query("SELECT key, max(seq) AS seq, arg_max(tombstone, seq) AS tombstone FROM log WHERE run IN (0, 1) GROUP BY key", R.LOG_SQL)
def kv_compact_minor(spark, d):
    own = R.log(spark, d).drop("run", "expire_at")
    parts = [own.where((F.col("seq") - 1) % 4 == i) for i in (0, 1)]
    return resolve.merge(*parts).select("key", "seq", "tombstone")


@query("SELECT key, value, seq FROM resolved WHERE NOT tombstone", R.STATE_SQL)
def kv_compact_major(spark, d):
    own = R.log(spark, d)
    return resolve.live(resolve.merge(*[own.where(F.col("run") == i) for i in range(R.RUNS)])).select("key", "value", "seq")


@query("SELECT (SELECT count(*) FROM log) AS entries_in, count(*) AS entries_out, count(*) FILTER (tombstone) AS tombstones FROM resolved", R.STATE_SQL)
def kv_compact_summary(spark, d):
    own = R.log(spark, d).groupBy("key").agg(F.count("*").alias("n"), F.max_by("tombstone", "seq").alias("gone"))
    return own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries_in"), F.count("*").alias("entries_out"), F.count_if("gone").alias("tombstones"))


@query("SELECT count(*) AS entries, count(*) FILTER (NOT tombstone) AS live, sum(strlen(key) + coalesce(strlen(value), 0))::BIGINT AS bytes, sum(strlen(key) + coalesce(strlen(value), 0)) >= 67108864 AS should_flush FROM resolved", R.STATE_SQL)
def kv_memtable_bytes(spark, d):
    return resolve.memtable(R.log(spark, d).drop("run"))


@query("SELECT max(seq) + 1 AS next_seq FROM log", R.LOG_SQL)
def kv_next_seq(spark, d):
    return resolve.next_seq(R.log(spark, d))


@query("SELECT key, value FROM orders_kv WHERE key LIKE 'order:12%'", R.ORDERS_SQL)
def kv_scan_prefix(spark, d):
    return scan.prefix(R.orders(spark, d), "order:12")


@query("SELECT key, value FROM orders_kv WHERE key >= 'order:2' AND key < 'order:3'", R.ORDERS_SQL)
def kv_scan_range(spark, d):
    return scan.between(R.orders(spark, d), "order:2", "order:3")


def _in_order(scanned: DataFrame) -> DataFrame:
    """(pos, key): the place of each row as the scan gave it."""
    return numbered(scanned.select("key").withColumn("at", F.monotonically_increasing_id()), "at", "pos").select("pos", "key")


@query("SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key FROM orders_kv WHERE key LIKE 'order:1%'", R.ORDERS_SQL)
def kv_scan_prefix_order(spark, d):
    return _in_order(scan.prefix(R.orders(spark, d), "order:1"))


@query("SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key FROM view WHERE key >= 'user:00001'", R.STATE_SQL)
def kv_scan_range_order(spark, d):
    return _in_order(scan.between(resolve.view(R.log(spark, d)), "user:00001"))


@query("SELECT count(*) AS n FROM orders_kv", R.ORDERS_SQL)
def kv_count(spark, d):
    return scan.count(R.orders(spark, d))


@query("SELECT n, key FROM (SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS key, row_number() OVER (ORDER BY lpad(o_orderkey::VARCHAR, 10, '0')) - 1 AS n FROM orders) WHERE n % 16 = 0")
def kv_sparse_index(spark, d):
    return runs.sparse_index(R.table(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("key")))


WANTED = ["user:000007", "user:000001", "absent", "user:000042", "user:000007", "user:000149"]
_WANTED_SQL = ", wanted AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(WANTED)) + ") w(pos, key))"


@query("SELECT w.pos, w.key, v.value FROM (SELECT key, min(pos) AS pos FROM wanted GROUP BY key) w LEFT JOIN view v USING (key)", R.STATE_SQL + _WANTED_SQL)
def kv_mget(spark, d):
    return scan.mget(resolve.view(R.log(spark, d)), scan.keys_frame(spark, WANTED))


@query("SELECT w.pos, w.key, v.value FROM wanted w LEFT JOIN view v USING (key)", R.STATE_SQL + _WANTED_SQL)
def resp_mget(spark, d):
    return scan.multi_get(resolve.view(R.log(spark, d)), scan.keys_frame(spark, WANTED))


@query("SELECT count(*) FILTER (v.key IS NULL) = 0 AS all_exist FROM wanted w LEFT JOIN view v USING (key)", R.STATE_SQL + _WANTED_SQL)
def kv_mexists(spark, d):
    return scan.mexists(resolve.view(R.log(spark, d)), scan.keys_frame(spark, WANTED))


@query("SELECT count(DISTINCT key) AS deleted FROM wanted JOIN view USING (key)", R.STATE_SQL + _WANTED_SQL)
def kv_del_count(spark, d):
    return scan.count_distinct_present(resolve.view(R.log(spark, d)), scan.keys_frame(spark, WANTED))


@query("SELECT count(*) AS present FROM wanted JOIN view USING (key)", R.STATE_SQL + _WANTED_SQL)
def kv_exists_count(spark, d):
    return scan.count_present(resolve.view(R.log(spark, d)), scan.keys_frame(spark, WANTED))


@query("SELECT * FROM view WHERE key NOT IN ('a', 'user:000007') UNION ALL SELECT 'a', '1' UNION ALL SELECT 'user:000007', 'new'", R.STATE_SQL)
def kv_mput(spark, d):
    own = R.log(spark, d).drop("run", "expire_at")
    return resolve.view(batch.appended(own, batch.mput(spark, {"a": "1", "user:000007": "new"}, 1 << 40).drop("expire_at", "source")))


@query("SELECT key, value FROM view WHERE key NOT IN (SELECT key FROM wanted)", R.STATE_SQL + _WANTED_SQL)
def kv_mdelete(spark, d):
    own = R.log(spark, d).drop("run", "expire_at")
    return resolve.view(batch.appended(own, batch.mdelete(spark, WANTED, 1 << 40).drop("expire_at", "source")))


# Time to live (T)

@query(f"SELECT w.key, CASE WHEN r.key IS NULL OR r.tombstone OR expire_at <= {AS_OF} THEN -2 WHEN expire_at IS NULL THEN -1 ELSE expire_at - {AS_OF} END::BIGINT AS ttl_ms FROM (SELECT DISTINCT key FROM log UNION ALL SELECT 'absent') w LEFT JOIN resolved r USING (key)", R.STATE_SQL)
def kv_ttl(spark, d):
    own = R.log(spark, d).drop("run")
    wanted = own.select("key").distinct().unionByName(spark.createDataFrame([("absent",)], "key string"))
    return ttl.ttl(resolve.live(resolve.newest(own)), wanted, AS_OF)


@query(f"SELECT key, value, expire_at FROM resolved WHERE NOT tombstone AND (expire_at IS NULL OR expire_at > {AS_OF})", R.STATE_SQL)
def kv_ttl_visible(spark, d):
    return ttl.visible(resolve.live(resolve.newest(R.log(spark, d).drop("run"))), AS_OF).select("key", "value", "expire_at")


@query(f"SELECT key, seq, expire_at FROM resolved WHERE NOT tombstone AND expire_at <= {AS_OF}", R.STATE_SQL)
def kv_ttl_expired(spark, d):
    return ttl.expired(resolve.live(resolve.newest(R.log(spark, d).drop("run"))), AS_OF).select("key", "seq", "expire_at")


@query(f"SELECT count(*) FILTER (expire_at IS NULL OR expire_at > {AS_OF}) AS visible, count(*) FILTER (expire_at <= {AS_OF}) AS expired FROM resolved WHERE NOT tombstone", R.STATE_SQL)
def kv_ttl_counts(spark, d):
    return ttl.counts(resolve.live(resolve.newest(R.log(spark, d).drop("run"))), AS_OF)


# Placement (P)

@query("SELECT token, node_id FROM ring", R.ring_sql("ring", 3))
def ring_tokens(spark, d):
    return ring.tokens(R.nodes(spark, 3))


@query("SELECT node_id, count(*) AS tokens FROM ring WHERE node_id <> 'node2' GROUP BY node_id", R.ring_sql("ring", 3))
def ring_summary(spark, d):
    return ring.summary(ring.without(ring.tokens(R.nodes(spark, 3)), "node2"))


@query(f"SELECT key, node_id FROM {R.primary_sql('orders_kv', 'ring')}", f"{R.ORDERS_SQL}, {R.ring_sql('ring', 3)}")
def ring_primary(spark, d):
    return ring.primary(R.orders(spark, d).select("key"), ring.tokens(R.nodes(spark, 3)))


_REPLICAS_SQL = f"""{R.STATE_SQL}, {R.ring_sql('ring', 5)},
nexts AS (SELECT t.token, o.node_id, min((o.token::HUGEINT - t.token + 9223372036854775808::HUGEINT) % 9223372036854775808::HUGEINT) AS away FROM ring t, ring o GROUP BY t.token, o.node_id),
lists AS (SELECT token, node_id, row_number() OVER (PARTITION BY token ORDER BY away) - 1 AS replica_pos FROM nexts),
placed AS (SELECT h.key, coalesce(r.token, (SELECT min(token) FROM ring)) AS token FROM (SELECT DISTINCT key, {R.TOKEN.format('key')} AS t FROM log) h ASOF LEFT JOIN ring r ON h.t <= r.token),
placement AS (SELECT p.key, l.replica_pos::INTEGER AS replica_pos, l.node_id FROM placed p JOIN lists l USING (token) WHERE l.replica_pos < 3)"""


@query("SELECT key, replica_pos, node_id FROM placement", _REPLICAS_SQL)
def ring_replicas(spark, d):
    return _placement(spark, d, 5)


def _placement(spark, d, n):
    return ring.replica_rows(R.log(spark, d).select("key").distinct(), ring.tokens(R.nodes(spark, n)), 3)


_STORES_SQL = f"{R.ORDERS_SQL}, {R.ring_sql('r3', 3)}, {R.ring_sql('r4', 4)}, p3 AS {R.primary_sql('orders_kv', 'r3')}, p4 AS {R.primary_sql('orders_kv', 'r4')}"


@query("SELECT key, value, p3.node_id AS source, p4.node_id AS target FROM orders_kv JOIN p3 USING (key) JOIN p4 USING (key) WHERE p4.node_id = 'node4'", _STORES_SQL)
def ring_rebalance_join(spark, d):
    stores = ring.primary(R.orders(spark, d), ring.tokens(R.nodes(spark, 3)))
    return ring.moves_on_join(stores, ring.tokens(R.nodes(spark, 4)), "node4")


@query("SELECT key, value, p4.node_id AS source, p3.node_id AS target FROM orders_kv JOIN p3 USING (key) JOIN p4 USING (key) WHERE p4.node_id = 'node4'", _STORES_SQL)
def ring_rebalance_leave(spark, d):
    after = ring.tokens(R.nodes(spark, 4))
    return ring.moves_on_leave(ring.primary(R.orders(spark, d), after), ring.without(after, "node4"), "node4")


@query("SELECT count(*) AS keys, count(*) FILTER (p3.node_id <> p4.node_id) AS moved, count(*) FILTER (p3.node_id <> p4.node_id) / count(*) AS fraction FROM p3 JOIN p4 USING (key)", _STORES_SQL)
def ring_remap(spark, d):
    return ring.remap_fraction(R.orders(spark, d), ring.tokens(R.nodes(spark, 3)), ring.tokens(R.nodes(spark, 4)))


# Quorum, repair, hints (Q)

_UP = ["node1", "node3", "node4"]
_UP_SQL = ", up AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in _UP) + ") u(node_id))"


def _up(spark):
    return spark.createDataFrame([(n,) for n in _UP], "node_id string")


def _state(spark, d):
    """What five replicas hold of the keys placed on them."""
    return R.replica_state(R.log(spark, d), 5)


_STATE5_SQL = _REPLICAS_SQL + _UP_SQL + ", held AS (SELECT 'node' || (i + 1) AS node_id, key, value, seq, tombstone FROM log, range(5) t(i) WHERE seq % 5 <> i)"


@query("SELECT key, count(u.node_id) AS acks, count(u.node_id) >= 2 AS ok FROM placement LEFT JOIN up u USING (node_id) GROUP BY key", _REPLICAS_SQL + _UP_SQL)
def quorum_ack(spark, d):
    return quorum.acks(_placement(spark, d, 5), _up(spark), quorum.Quorum())


_ASKED_SQL = _STATE5_SQL + """,
ranked AS (SELECT p.*, row_number() OVER (PARTITION BY key ORDER BY replica_pos) AS n, count(*) OVER (PARTITION BY key) AS c FROM placement p SEMI JOIN up USING (node_id)),
answers AS (SELECT r.key, replica_pos, value, seq, tombstone FROM ranked r JOIN held USING (key, node_id) WHERE n <= 2 AND c >= 2)"""


@query("SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, replica_pos) AS n FROM answers) WHERE n = 1 AND NOT tombstone", _ASKED_SQL.replace("WITH ", ""))
def quorum_read(spark, d):
    return quorum.read(_placement(spark, d, 5), _up(spark), _state(spark, d), quorum.Quorum())


_WON_SQL = _STATE5_SQL + """,
own AS (SELECT p.key, p.node_id, max(h.seq) AS seq FROM placement p LEFT JOIN held h ON h.key = p.key AND h.node_id = p.node_id GROUP BY p.key, p.node_id),
won AS (SELECT key, max(seq) AS seq FROM own GROUP BY key HAVING max(seq) IS NOT NULL)"""


@query("SELECT o.node_id, o.key, l.value, w.seq, l.tombstone FROM own o JOIN won w USING (key) JOIN log l ON l.key = w.key AND l.seq = w.seq WHERE o.seq IS NULL OR o.seq < w.seq", _WON_SQL)
def read_repair_stale(spark, d):
    return quorum.repairs(_placement(spark, d, 5), _newest_state(spark, d))


def _newest_state(spark, d):
    return resolve.newest(_state(spark, d), by=["node_id", "key"])


@query("SELECT s.node_id, s.key, l.value, s.seq, l.tombstone FROM (SELECT node_id, key, max(seq) AS seq FROM (SELECT node_id, key, seq FROM held UNION ALL SELECT o.node_id, o.key, w.seq FROM own o JOIN won w USING (key)) GROUP BY node_id, key) s JOIN log l USING (key, seq)", _WON_SQL)
def read_repair_state(spark, d):
    return quorum.repaired(_placement(spark, d, 5), _newest_state(spark, d))


_HINTS_SQL = _STATE5_SQL + ", missed AS (SELECT p.node_id AS target, CASE WHEN tombstone THEN 'DELETE' ELSE 'PUT' END AS op, l.key, l.value, l.seq FROM log l JOIN placement p USING (key) WHERE p.node_id NOT IN (SELECT node_id FROM up))"


def _hints(spark, d):
    return quorum.hints(_placement(spark, d, 5), _up(spark), R.log(spark, d))


@query("SELECT target, op, key, value, seq FROM missed", _HINTS_SQL)
def hints_stored(spark, d):
    return _hints(spark, d)


@query("SELECT target, count(*) AS pending FROM missed GROUP BY target", _HINTS_SQL)
def hints_pending(spark, d):
    return quorum.pending(_hints(spark, d))


def _hint_members(spark):
    return spark.createDataFrame([("node2", "ACTIVE"), ("node5", "SUSPECT")], "node_id string, status string")


@query("SELECT s.node_id, s.key, l.value, s.seq, l.tombstone FROM (SELECT node_id, key, max(seq) AS seq FROM (SELECT node_id, key, seq FROM held UNION ALL SELECT target, key, seq FROM missed WHERE target = 'node2') GROUP BY node_id, key) s JOIN log l USING (key, seq)", _HINTS_SQL)
def hints_replay(spark, d):
    return quorum.replayed(_newest_state(spark, d), _hints(spark, d), _hint_members(spark))


@query("SELECT target, op, key, value, seq FROM missed WHERE target <> 'node2'", _HINTS_SQL)
def hints_remaining(spark, d):
    return quorum.remaining(_hints(spark, d), _hint_members(spark))


# Members, failure detection, gossip (G)

_NODE = "concat('user', cast(user_id as string))"


@query(f"SELECT 'user' || user_id AS node_id, ({DETECT_AT} - max(epoch_us(ts) // 1000))::BIGINT AS elapsed_ms, CASE WHEN {DETECT_AT} - max(epoch_us(ts) // 1000) >= {DOWN_MS} THEN 'DOWN' WHEN {DETECT_AT} - max(epoch_us(ts) // 1000) >= {SUSPECT_MS} THEN 'SUSPECT' ELSE 'ACTIVE' END AS status FROM events GROUP BY user_id UNION ALL SELECT 'silent', -1, 'ACTIVE'")
def fd_status(spark, d):
    beats = R.table(spark, d, "events").select(F.expr(_NODE).alias("node_id"), R.millis("ts").alias("ts"))
    tracked = beats.select("node_id").distinct().unionByName(spark.createDataFrame([("silent",)], "node_id string"))
    return membership.detect(tracked, beats, DETECT_AT, SUSPECT_MS, DOWN_MS)


_MEMBER_EVENTS_SQL = """ev AS (SELECT 'n' || user_id AS node_id, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'leave' WHEN event_id % 5 = 0 THEN 'down' WHEN event_id % 3 = 0 THEN 'suspect' ELSE 'join' END AS event FROM events),
k AS (SELECT *, last_value(CASE WHEN event IN ('join', 'leave') THEN event END IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY seq) AS entry FROM ev),
l AS (SELECT node_id, arg_max(event, seq) AS event FROM k WHERE entry = 'join' OR event = 'leave' GROUP BY node_id),
members AS (SELECT node_id, CASE event WHEN 'join' THEN 'ACTIVE' WHEN 'suspect' THEN 'SUSPECT' ELSE 'DOWN' END AS status FROM l WHERE event <> 'leave')"""


def _members(spark, d):
    i = F.col("event_id")
    event = F.when(i % 7 == 0, "leave").when(i % 5 == 0, "down").when(i % 3 == 0, "suspect").otherwise("join")
    return membership.members(R.table(spark, d, "events").select(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("node_id"), event.alias("event"), i.alias("seq")))


@query("SELECT node_id, status FROM members", _MEMBER_EVENTS_SQL)
def members_status(spark, d):
    return _members(spark, d)


@query("SELECT count(*) AS total, count(*) FILTER (status = 'ACTIVE') AS active FROM members", _MEMBER_EVENTS_SQL)
def members_counts(spark, d):
    return membership.status_counts(_members(spark, d))


@query("""SELECT '{"total":' || count(*) || ',"active":' || count(*) FILTER (status = 'ACTIVE') || '}' AS body FROM members""", _MEMBER_EVENTS_SQL)
def admin_status(spark, d):
    return membership.status_json(_members(spark, d))


@query("""SELECT CASE WHEN count(*) FILTER (status = 'ACTIVE') > 0 THEN '{"status":"UP","activeNodes":' || count(*) FILTER (status = 'ACTIVE') || '}' ELSE '{"status":"DEGRADED","activeNodes":0}' END AS body FROM members""", _MEMBER_EVENTS_SQL)
def admin_health(spark, d):
    return membership.health_json(_members(spark, d))


@query("""SELECT host || ':' || port AS node_id, host, port::INTEGER AS port, 'ACTIVE' AS status FROM (SELECT 'h' || event_id AS host, 1000 + user_id AS port FROM events WHERE event_id % 5 IN (0, 1)
UNION ALL SELECT 'g' || event_id, 7 FROM events WHERE event_id % 5 IN (0, 2))""")
def seeds_parsed(spark, d):
    """Seed lists of events: whole ones, and with a host without a port, a port that is none, one without a host, and nothing."""
    i, host = F.col("event_id").cast("string"), F.concat(F.lit("h"), F.col("event_id").cast("string"), F.lit(":"), (F.col("user_id") + 1000).cast("string"))
    other = F.concat(F.lit("g"), i, F.lit(":7"))
    lists = F.element_at(F.array(F.concat(host, F.lit(", "), other), F.concat(host, F.lit(",h"), i), F.concat(F.lit("h:x,"), other), F.concat(F.lit(":"), i), F.lit("")), (F.col("event_id") % 5 + 1).cast("int"))
    return membership.seeds(R.table(spark, d, "events").select(lists.alias("seeds")))


_GOSSIP_SQL = """g AS (SELECT event_id % 3 AS o, 'n' || user_id AS node_id, event_type AS status, event_id // 10 AS version FROM events),
d AS (SELECT o, node_id, max(version) AS version, min(status) AS status FROM g GROUP BY o, node_id)"""


def _digests(spark, d):
    e = R.table(spark, d, "events").select((F.col("event_id") % 3).alias("o"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("node_id"), F.col("event_type").alias("status"), F.floor(F.col("event_id") / 10).alias("version"))
    return e.groupBy("o", "node_id").agg(F.max("version").alias("version"), F.min("status").alias("status"))


@query("SELECT node_id, CASE WHEN b.version IS NULL OR a.version >= b.version THEN a.status ELSE b.status END AS status, greatest(coalesce(a.version, b.version), coalesce(b.version, a.version)) AS version FROM (SELECT * FROM d WHERE o = 0) a FULL JOIN (SELECT * FROM d WHERE o = 1) b USING (node_id)".replace("WHEN b.version IS NULL OR", "WHEN b.version IS NULL OR (a.version IS NOT NULL) AND"), _GOSSIP_SQL)
def gossip_merge(spark, d):
    g = _digests(spark, d)
    return membership.gossip_merge(g.where("o = 0"), g.where("o = 1"))


@query("SELECT count(*) FILTER (a.version IS NULL OR b.version > a.version) AS updated FROM (SELECT * FROM d WHERE o = 1) b LEFT JOIN (SELECT * FROM d WHERE o = 0) a USING (node_id)", _GOSSIP_SQL)
def gossip_updates(spark, d):
    g = _digests(spark, d)
    return membership.gossip_updates(g.where("o = 0"), g.where("o = 1"))


@query("""SELECT observer, node_id, max(version) AS version FROM (SELECT 'n' || o AS observer, node_id, version + CASE WHEN 'n' || o = node_id THEN 1 ELSE 0 END AS version FROM d
UNION ALL SELECT 'n' || ((o + 1) % 3), node_id, version + CASE WHEN 'n' || o = node_id THEN 1 ELSE 0 END FROM d) GROUP BY observer, node_id""", _GOSSIP_SQL)
def gossip_round(spark, d):
    state = _digests(spark, d).select(F.concat(F.lit("n"), F.col("o").cast("string")).alias("observer"), "node_id", "status", "version")
    edges = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 3}") for i in range(3)], "src string, dst string")
    return membership.gossip_round(state, edges).select("observer", "node_id", "version")


# Replicated log (F, R8, R12, R13)

_RAFT_SQL = """leader AS (SELECT event_id + 1 AS index, event_id // 500 + 1 AS term, CASE event_type WHEN 'error' THEN 'Delete' WHEN 'view' THEN 'NoOp' ELSE 'Put' END AS cmd, 'k' || user_id AS key, event_type AS value FROM events)"""


def _leader(spark, d):
    cmd = F.when(F.col("event_type") == "error", "Delete").when(F.col("event_type") == "view", "NoOp").otherwise("Put")
    return R.table(spark, d, "events").select((F.col("event_id") + 1).alias("index"), (F.floor(F.col("event_id") / 500) + 1).alias("term"), cmd.alias("cmd"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"))


_COMMIT_SQL = """SELECT greatest(coalesce(max(index), 0), 0)::BIGINT AS commit_index FROM leader WHERE term = (SELECT max(term) FROM leader) AND index <=
(SELECT m FROM (SELECT (SELECT max(index) FROM leader) - i * 37 AS m, row_number() OVER (ORDER BY (SELECT max(index) FROM leader) - i * 37 DESC) AS r FROM range(5) t(i)) WHERE r = 3)"""


@query(_COMMIT_SQL, _RAFT_SQL)
def raft_commit_index(spark, d):
    leader = _leader(spark, d)
    top = leader.agg(F.max("index").alias("m"), F.max("term").alias("t")).first()
    matches = spark.createDataFrame([(f"n{i}", (top.m or 0) - i * 37) for i in range(5)], "node_id string, match_index long")
    return raftlog.commit_index(matches, leader, top.t or 0)


@query("SELECT index, CASE WHEN index < 700 THEN term ELSE term END AS term, cmd, key, value FROM leader", _RAFT_SQL)
def raft_log_conflict(spark, d):
    leader = _leader(spark, d)
    follower = leader.where("index <= 900").withColumn("term", F.when(F.col("index") >= 700, F.col("term") + 9).otherwise(F.col("term"))).withColumn("value", F.when(F.col("index") >= 700, F.lit("bad")).otherwise(F.col("value")))
    return raftlog.appended(follower, leader, 0, 0)


@query("SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY index DESC) AS n FROM leader WHERE cmd <> 'NoOp' AND index <= (" + _COMMIT_SQL + ")) WHERE n = 1 AND cmd = 'Put'", _RAFT_SQL)
def raft_fold(spark, d):
    """The state of all that a majority has."""
    return raftlog.fold(_leader(spark, d), raft_commit_index(spark, d).first().commit_index)


_ROUND_SQL = _RAFT_SQL + """, old AS (SELECT 'n' || i AS node_id, index, CASE WHEN index > last * (9 - i) // 10 THEN term + i ELSE term END AS term, cmd, key, value
FROM leader, (SELECT max(index) AS last FROM leader), range(1, 5) t(i) WHERE index <= last * (10 - i) // 10),
grown AS (SELECT * FROM leader UNION ALL SELECT (SELECT max(index) FROM leader) + n + 1, (SELECT max(term) FROM leader) + 9, 'Put', 'new' || n, 'v' FROM range(40) t(n)),
round AS (SELECT 'n0' AS node_id, * FROM grown UNION ALL SELECT node_id, g.* FROM grown g, (SELECT unnest(['n1', 'n3']) AS node_id) UNION ALL SELECT * FROM old WHERE node_id IN ('n2', 'n4'))"""


def _round(spark, d):
    """A leader and four followers, each shorter than the one before and with a tail of another term; forty new commands; two followers are reached."""
    leader = _leader(spark, d)
    top = leader.agg(F.max("index").alias("last"), F.max("term").alias("term")).first()
    last, term = top.last or 0, (top.term or 0) + 9
    old = leader.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(4)))).where(F.col("index") <= F.floor(F.lit(last) * (10 - F.col("i")) / 10))
    old = old.withColumn("term", F.when(F.col("index") > F.floor(F.lit(last) * (9 - F.col("i")) / 10), F.col("term") + F.col("i")).otherwise(F.col("term")))
    old = old.select(F.concat(F.lit("n"), F.col("i").cast("string")).alias("node_id"), "index", "term", "cmd", "key", "value")
    new = spark.range(40).select(F.col("id").alias("pos"), F.lit("Put").alias("cmd"), F.concat(F.lit("new"), F.col("id").cast("string")).alias("key"), F.lit("v").alias("value"))
    logs = old.unionByName(raftlog.proposed(leader, new, term).withColumn("node_id", F.lit("n0")))
    return raftlog.replicated(logs, "n0", spark.createDataFrame([("n1",), ("n3",)], "node_id string")), term


@query("SELECT node_id, index, term, cmd, key, value FROM round", _ROUND_SQL)
def raft_round(spark, d):
    return _round(spark, d)[0]


@query("SELECT max(index) AS commit_index FROM grown", _ROUND_SQL)
def raft_round_commit(spark, d):
    """The leader and two of four followers have the new entries: all of them are committed."""
    logs, term = _round(spark, d)
    return raftlog.commit_index(raftlog.matched(logs, "n0"), logs.where("node_id = 'n0'"), term)


@query("SELECT term, count(*) AS entries FROM leader WHERE index >= 100 AND index < 600 GROUP BY term", _RAFT_SQL)
def raft_slice(spark, d):
    return raftlog.part(_leader(spark, d), 100, 600).groupBy("term").agg(F.count("*").alias("entries"))


_VOTES_SQL = """req AS (SELECT event_id AS pos, 'v' || user_id % 5 AS voter, event_type AS candidate, event_id // 40 + user_id % 3 AS term, event_id % 50 AS last_index, event_id % 4 AS last_term FROM events),
fitting AS (SELECT *, term >= coalesce(max(term) OVER (PARTITION BY voter ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AND (last_term > 1 OR last_term = 1 AND last_index >= 25) AS fit FROM req),
firsts AS (SELECT voter, term, arg_min(candidate, pos) AS first FROM fitting WHERE fit GROUP BY voter, term),
granted AS (SELECT pos, voter, candidate, term, fit AND candidate = first AS granted FROM fitting LEFT JOIN firsts USING (voter, term))"""


@query("SELECT pos, voter, candidate, term, coalesce(granted, false) AS granted FROM granted", _VOTES_SQL)
def raft_votes(spark, d):
    return _votes(spark, d)


def _votes(spark, d):
    """Five voters with logs that end at (term 1, index 25), asked for votes by events."""
    i, u = F.col("event_id"), F.col("user_id")
    requests = R.table(spark, d, "events").select(i.alias("pos"), F.concat(F.lit("v"), (u % 5).cast("string")).alias("voter"), F.col("event_type").alias("candidate"), (F.floor(i / 40) + u % 3).alias("term"), (i % 50).alias("last_index"), (i % 4).alias("last_term"))
    voters = spark.range(0, 5, 1, 1).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("voter"), F.lit(0).alias("term"), F.lit(25).alias("last_index"), F.lit(1).alias("last_term"))
    return raftlog.votes(requests, voters)


@query("SELECT term, candidate, count(DISTINCT voter) AS votes FROM granted WHERE granted GROUP BY term, candidate HAVING count(DISTINCT voter) >= 3", _VOTES_SQL)
def raft_elected(spark, d):
    return raftlog.elected(_votes(spark, d), 5)


_PEERS_SQL = "peers AS (SELECT 'n' || user_id AS node_id, CASE WHEN user_id % 5 = 0 THEN 'LEADER' WHEN user_id % 5 = 1 THEN 'CANDIDATE' ELSE 'FOLLOWER' END AS role, user_id % 7 AS term, max(epoch_us(ts) // 1000)::BIGINT AS heard FROM events GROUP BY user_id)"


def _peers(spark, d):
    role = F.when(F.col("user_id") % 5 == 0, "LEADER").when(F.col("user_id") % 5 == 1, "CANDIDATE").otherwise("FOLLOWER")
    heard = R.table(spark, d, "events").groupBy("user_id").agg(F.max(R.millis("ts")).alias("heard"))
    return heard.select(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("node_id"), role.alias("role"), (F.col("user_id") % 7).alias("term"), "heard")


_HEARD_BY = DETECT_AT - 40_000_000


@query(f"SELECT node_id AS candidate, term + 1 AS term FROM peers WHERE role <> 'LEADER' AND {_HEARD_BY} - heard >= 150 + ('0x' || substring(md5(node_id || '#' || term), 1, 8))::BIGINT % 150", _PEERS_SQL)
def raft_elections_due(spark, d):
    return raftlog.elections_due(_peers(spark, d), _HEARD_BY)


@query("SELECT node_id, CASE WHEN seen > term THEN 'FOLLOWER' ELSE role END AS role, greatest(term, coalesce(seen, term)) AS term FROM peers LEFT JOIN (SELECT 'n' || user_id AS node_id, max(event_id % 9) AS seen FROM events WHERE event_type = 'error' GROUP BY user_id) USING (node_id)", _PEERS_SQL)
def raft_stepped_down(spark, d):
    sent = R.table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("node_id"), (F.col("event_id") % 9).alias("term"))
    return raftlog.stepped_down(_peers(spark, d), sent)


@query("""SELECT event_id AS pos, CASE WHEN role IS NULL THEN 'UNKNOWN_NODE' WHEN event_type = 'view' OR role = 'LEADER' THEN 'OK' ELSE 'NOT_LEADER' END AS status,
CASE WHEN role IS NOT NULL AND event_type <> 'view' AND role <> 'LEADER' THEN (SELECT arg_max(node_id, term) FROM own WHERE role = 'LEADER') END AS leader
FROM events LEFT JOIN own ON own.node_id = 'n' || user_id""", _PEERS_SQL + ", own AS (SELECT node_id, CASE WHEN heard = (SELECT max(heard) FROM peers) THEN 'LEADER' ELSE 'FOLLOWER' END AS role, term FROM peers WHERE term <> 3)")
def raft_admitted(spark, d):
    """Requests to nodes of which some are not known and the one that was heard last leads."""
    peers = _peers(spark, d)
    top = peers.agg(F.max("heard").alias("top"))
    own = peers.join(top, F.lit(True)).where("term <> 3").select("node_id", F.when(F.col("heard") == F.col("top"), "LEADER").otherwise("FOLLOWER").alias("role"), "term")
    requests = R.table(spark, d, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("node_id"), F.when(F.col("event_type") == "view", "GET").otherwise("PUT").alias("op"))
    return raftlog.admitted(requests, own)


# Metrics (R9, R10, I17)

_OBSERVED_SQL = "o AS (SELECT event_type AS name, floor(value)::BIGINT AS value_ms FROM events)"


def _observations(spark, d):
    return R.table(spark, d, "events").select(F.col("event_type").alias("name"), F.floor("value").alias("value_ms"))


@query(" UNION ALL ".join(f"SELECT name, '{b or '+Inf'}' AS le, count(*) FILTER (value_ms <= {b or 2**62}) AS bucket FROM o GROUP BY name" for b in (*metrics.BOUNDS, None)), _OBSERVED_SQL)
def metrics_histogram(spark, d):
    return metrics.histogram(_observations(spark, d))


@query("SELECT name, sum(value_ms)::BIGINT AS value FROM o GROUP BY name", _OBSERVED_SQL)
def metrics_counters(spark, d):
    return metrics.counters(_observations(spark, d).withColumnRenamed("value_ms", "delta"))


@query("SELECT event_type AS name, arg_max(user_id, event_id) AS value FROM events GROUP BY event_type")
def metrics_gauges(spark, d):
    return metrics.gauges(R.table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("value"), F.col("event_id").alias("ts")))


@query("""SELECT 'counter' AS kind, name, '# TYPE ' || name || ' counter' || chr(10) || name || ' ' || sum(value_ms)::BIGINT || chr(10) AS text FROM o GROUP BY name UNION ALL
SELECT 'gauge', event_type, '# TYPE ' || event_type || ' gauge' || chr(10) || event_type || ' ' || arg_max(user_id, event_id) || chr(10) FROM events GROUP BY event_type UNION ALL
SELECT 'histogram', name, '# TYPE ' || name || ' histogram' || chr(10) || """ + " || ".join(f"name || '_bucket{{le=\"{b or '+Inf'}\"}} ' || count(*) FILTER (value_ms <= {b or 2**62}) || chr(10)".replace("{{", "{").replace("}}", "}") for b in (*metrics.BOUNDS, None)) + " || name || '_count ' || count(*) || chr(10) || name || '_sum ' || sum(value_ms)::BIGINT || chr(10) FROM o GROUP BY name", _OBSERVED_SQL)
def metrics_scrape(spark, d):
    return metrics.scrape(metrics_counters(spark, d), metrics_gauges(spark, d), _observations(spark, d))


# Formats and commands (I, D)

@query("SELECT key, '$' || strlen(value) || chr(13) || chr(10) || value || chr(13) || chr(10) AS reply FROM orders_kv", R.ORDERS_SQL)
def resp_bulk(spark, d):
    return R.orders(spark, d).select("key", codecs.resp_bulk(F.col("value")).alias("reply"))


BATCH = 64


@query(f"SELECT seq // {BATCH} AS batch, '*' || count(*) || chr(13) || chr(10) || string_agg(CASE WHEN value IS NULL THEN '$-1' ELSE '$' || strlen(value) || chr(13) || chr(10) || value END || chr(13) || chr(10), '' ORDER BY seq) AS reply FROM log GROUP BY seq // {BATCH}", R.LOG_SQL)
def resp_array(spark, d):
    """The whole log's values as array replies of so many each."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "value")))
    grouped = R.log(spark, d).groupBy(F.floor(F.col("seq") / BATCH).alias("batch")).agg(F.transform(ordered, lambda x: x["value"]).alias("v"))
    return grouped.select("batch", codecs.resp_array(F.col("v")).alias("reply"))


@query("""SELECT seq AS pos, CASE WHEN op = 'GET' AND held IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status, CASE op WHEN 'GET' THEN held WHEN 'EXISTS' THEN CASE WHEN held IS NULL THEN '0' ELSE '1' END END AS payload FROM
(SELECT *, (last_value(w IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)).v AS held FROM
 (SELECT key, seq, CASE WHEN tombstone THEN 'DELETE' WHEN run = 0 THEN 'PUT' WHEN run = 3 THEN 'EXISTS' ELSE 'GET' END AS op, CASE WHEN tombstone THEN {'v': NULL::VARCHAR} WHEN run = 0 THEN {'v': value} END AS w FROM log))""", R.LOG_SQL)
def resp_get_sequential(spark, d):
    op = F.when(F.col("tombstone"), "DELETE").when(F.col("run") == 0, "PUT").when(F.col("run") == 3, "EXISTS").otherwise("GET")
    return commands.dispatch(R.log(spark, d).select(F.col("seq").alias("pos"), op.alias("op"), "key", "value"))


@query("""SELECT event_id AS pos, CASE WHEN event_type = 'error' THEN ':' || CASE WHEN h IS NULL THEN 0 ELSE 1 END || chr(13) || chr(10) WHEN event_id % 3 = 0 THEN '+OK' || chr(13) || chr(10)
ELSE '*2' || chr(13) || chr(10) || CASE WHEN h IS NULL THEN '$-1' ELSE '$' || strlen(h) || chr(13) || chr(10) || h END || chr(13) || chr(10) || '$-1' || chr(13) || chr(10) END AS reply FROM
(SELECT *, (last_value(w IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)).v AS h FROM
 (SELECT *, CASE WHEN event_type = 'error' THEN {'v': NULL::VARCHAR} WHEN event_id % 3 = 0 THEN {'v': event_type} END AS w FROM events))""")
def resp_commands(spark, d):
    """Command bytes, parsed and answered."""
    e = R.table(spark, d, "events")
    words = F.when(F.col("event_type") == "error", F.array(F.lit("del"), F.col("k"), F.col("k"))).when(F.col("event_id") % 3 == 0, F.array(F.lit("SET"), F.col("k"), F.col("event_type"))).otherwise(F.array(F.lit("mget"), F.col("k"), F.lit("absent")))
    data = e.withColumn("k", F.concat(F.lit("k"), F.col("user_id").cast("string"))).select(F.col("event_id").alias("pos"), codecs.utf8(codecs.resp_array(words)).alias("data"))
    return commands.run_commands(resp.parse_commands(data)).select("pos", "reply")


def _hex8(expression: str, width: int) -> str:
    return f"lpad(hex({expression}), {2 * width}, '0')"


def _text_hex(expression: str) -> str:
    return f"{_hex8(f'strlen({expression})', 4)} || hex(encode({expression}))"


@query(f"SELECT seq, upper({_hex8('seq', 8)} || {_hex8('CASE WHEN tombstone THEN 2 ELSE 1 END', 1)} || {_text_hex('key')} || {_text_hex('value0')}) AS body FROM (SELECT *, coalesce(value, '') AS value0 FROM log)", R.LOG_SQL)
def wal_encode(spark, d):
    """Log entries without the checksum, as hex; tests compare the whole with an encoder of their own."""
    entry = log_source.encoded(R.log(spark, d))
    return entry.select("seq", F.hex(F.substring("entry", F.lit(1), F.octet_length("entry") - 4)).alias("body"))


@query(f"SELECT seq, upper({_hex8('CASE WHEN tombstone THEN 3 ELSE 1 END', 1)} || {_text_hex('key')} || {_text_hex('value0')}) AS frame, CASE WHEN tombstone THEN 'DELETE' ELSE 'PUT' END AS op, key, value FROM (SELECT *, coalesce(value, '') AS value0 FROM log)", R.LOG_SQL)
def wire_requests(spark, d):
    op = F.when(F.col("tombstone"), "DELETE").otherwise("PUT")
    coded = R.log(spark, d).select("seq", codecs.request(op, F.col("key"), F.col("value")).alias("c"))
    return coded.withColumn("r", codecs.read_request(F.col("c"))).select("seq", F.hex("c").alias("frame"), "r.op", "r.key", "r.value")


@query("SELECT seq, CASE WHEN tombstone THEN 'NOT_FOUND' ELSE 'OK' END AS status, value AS payload FROM log", R.LOG_SQL)
def wire_responses(spark, d):
    status = F.when(F.col("tombstone"), "NOT_FOUND").otherwise("OK")
    coded = R.log(spark, d).select("seq", codecs.response(status, F.col("value")).alias("c"))
    return coded.withColumn("r", codecs.read_response(F.col("c"))).select("seq", "r.*")


@query(f"SELECT seq, upper({_hex8('strlen(key)', 4)} || hex(encode(key))) AS frame FROM log", R.LOG_SQL)
def wire_frames(spark, d):
    return R.log(spark, d).select("seq", F.hex(codecs.frame(codecs.utf8(F.col("key")))).alias("frame"))


_CRC_SQL = """crc_table AS (SELECT list(c ORDER BY i) AS entries FROM (SELECT i, list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i)))"""


@query(f"""SELECT seq, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(body) // 2 + 1), lambda i: ('0x' || substring(body, 2 * i - 1, 2))::BIGINT)),
lambda c, b: xor(c >> 8, entries[xor(c, b) % 256 + 1])), 4294967295) AS crc FROM
(SELECT seq, {_hex8('seq', 8)} || {_hex8('CASE WHEN tombstone THEN 2 ELSE 1 END', 1)} || {_text_hex('key')} || {_text_hex('value0')} AS body FROM (SELECT *, coalesce(value, '') AS value0 FROM log)), crc_table""", f"{R.LOG_SQL}, {_CRC_SQL}")
def crc32_values(spark, d):
    """The checksums that log entries bear, each held against the bytes before it; an error where one is wrong."""
    entry = log_source.encoded(R.log(spark, d))
    body, borne = F.substring("entry", F.lit(1), F.octet_length("entry") - 4), codecs.read_number(F.col("entry"), F.octet_length("entry") - 4, 4)
    return entry.select("seq", F.crc32(hashing.crc_matches(body, borne)).alias("crc"))


_MIX = "CASE WHEN {0} >= 9223372036854775808::UHUGEINT THEN {0}::HUGEINT - 18446744073709551616::HUGEINT ELSE {0}::HUGEINT END"


def _mix_sql(seed: int) -> str:
    """The 64-bit mix of the key's bytes, in numbers of 128 bits cut to 64."""
    whole = "18446744073709551616::UHUGEINT"
    step = f"(xor(h, b) * {bloom.STEP}::UHUGEINT) % {whole}"
    folded = f"list_reduce(list_concat([{seed}::UHUGEINT], bytes), lambda h, b: xor({step}, ({step}) >> 33))"
    last = f"xor({folded}, len(bytes)::UHUGEINT)"
    product = f"((xor({last}, ({last}) >> 33)) * {bloom.LAST}::UHUGEINT) % {whole}"
    return f"xor({product}, ({product}) >> 33)"


BLOOM_RATE = 0.01


@query("SELECT key, present, bool_and(place IN (SELECT place FROM places WHERE present)) AS maybe FROM places GROUP BY key, present", R.STATE_SQL + f""",
probes AS (SELECT key, true AS present FROM view UNION ALL SELECT 'absent:' || key, false FROM view),
coded AS (SELECT key, present, list_transform(range(1, strlen(key) + 1), lambda i: ('0x' || substring(hex(encode(key)), 2 * i - 1, 2))::UHUGEINT) AS bytes FROM probes),
mixed AS (SELECT key, present, {_mix_sql(bloom.SEEDS[0])} AS h1, {_mix_sql(bloom.SEEDS[1])} AS h2 FROM coded),
sized AS (SELECT ceil(-n * ln({BLOOM_RATE}::DOUBLE) / (ln(2::DOUBLE) * ln(2::DOUBLE)))::HUGEINT AS bits, n FROM (SELECT greatest(count(*), 1)::DOUBLE AS n FROM view)),
hashes AS (SELECT bits, greatest(1, floor(bits / n * ln(2::DOUBLE) + 0.5))::BIGINT AS k FROM sized),
turned AS (SELECT key, present, bits, (h1 + i::UHUGEINT * h2) % 18446744073709551616::UHUGEINT AS h FROM mixed, hashes, range(64) t(i) WHERE i < k),
places AS (SELECT key, present, (({_MIX.format("h")}) % bits + bits) % bits AS place FROM turned)""")
def bloom_probe(spark, d):
    """Present and absent keys against the filter of the live keys."""
    view = resolve.view(R.log(spark, d)).select("key")
    filter_ = bloom.build(view, max(1, view.count()), BLOOM_RATE).first().bloom
    probes = view.withColumn("present", F.lit(True)).unionByName(view.select(F.concat(F.lit("absent:"), "key").alias("key"), F.lit(False).alias("present")))
    return bloom.probe(probes, bytes(filter_))


@query(f"SELECT seq // {BATCH} AS batch, row_number() OVER (PARTITION BY seq // {BATCH} ORDER BY seq) - 1 AS pos, key AS content, 0 AS rest FROM log", R.LOG_SQL)
def wire_frame_stream(spark, d):
    """Frames of keys in a row, so many a stream, taken apart again."""
    framed = R.log(spark, d).select("seq", codecs.frame(codecs.utf8(F.col("key"))).alias("f")).groupBy(F.floor(F.col("seq") / BATCH).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("seq", "f"))).alias("fs"))
    stream = F.aggregate("fs", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["f"]))
    read = framed.select("batch", codecs.read_frames(stream).alias("r")).select("batch", F.posexplode("r.frames").alias("pos", "frame"), F.octet_length("r.rest").alias("rest"))
    return read.select("batch", "pos", F.decode("frame", "UTF-8").alias("content"), "rest")


@query("SELECT w.key, r.value, r.seq, r.tombstone FROM (SELECT key FROM wanted UNION SELECT key FROM log WHERE seq % 7 = 0) w JOIN resolved r USING (key)", R.STATE_SQL + _WANTED_SQL)
def run_lookup(spark, d):
    """Keys looked up one by one in the run files whose range holds them, by each run's own index."""
    folder = scratch_path(spark, "runs")
    runs.write(resolve.newest(R.log(spark, d).drop("run", "expire_at")), folder, 4)
    wanted = scan.keys_frame(spark, WANTED).select("key").unionByName(R.log(spark, d).where("seq % 7 = 0").select("key")).distinct()
    return runs.lookup(spark, folder, wanted)


@query(f"SELECT key, value, expire_at FROM (SELECT key, value, expire_at FROM resolved WHERE NOT tombstone AND key NOT IN ('session:1', 'session:2', 'user:000007') UNION ALL SELECT 'session:1', 's1', {AS_OF + 40_000} UNION ALL SELECT 'session:2', 's2', {AS_OF - 10_000} UNION ALL SELECT 'user:000007', 'short', {AS_OF + 1}) WHERE expire_at IS NULL OR expire_at > {AS_OF}", R.STATE_SQL)
def kv_ttl_put(spark, d):
    """Writes with a time to live: visible until it is over."""
    own = R.log(spark, d).drop("run")
    writes = [("session:1", "s1", AS_OF - 20_000, 60_000), ("session:2", "s2", AS_OF - 70_000, 60_000), ("user:000007", "short", AS_OF - 9, 10)]
    rows = [(k, v, (1 << 40) + i, False, ttl.deadline(now, ms)) for i, (k, v, now, ms) in enumerate(writes)]
    put = spark.createDataFrame(rows, own.schema)
    return ttl.visible(resolve.live(resolve.newest(own.unionByName(put))), AS_OF).select("key", "value", "expire_at")


_CRLF = "chr(13) || chr(10)"


@query(f"""SELECT event_id AS pos, CASE event_id % 8 WHEN 0 THEN '+PONG' || {_CRLF} WHEN 1 THEN '$' || strlen(event_type) || {_CRLF} || event_type || {_CRLF} WHEN 2 THEN '+OK' || {_CRLF}
WHEN 3 THEN ':' || (CASE WHEN h IS NULL THEN 0 ELSE 2 END) || {_CRLF} WHEN 4 THEN '+OK' || {_CRLF} WHEN 5 THEN '-ERR unknown command ' || chr(39) || 'BOGUS' || chr(39) || {_CRLF} WHEN 6 THEN '-ERR GET requires key' || {_CRLF}
ELSE CASE WHEN h IS NULL THEN '$-1' ELSE '$' || strlen(h) || {_CRLF} || h END || {_CRLF} END AS reply FROM
(SELECT *, last_value(CASE WHEN event_id % 8 = 2 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM events)""")
def resp_more_commands(spark, d):
    """PING, MSET, EXISTS, COMMAND, GET, and commands that are wrong."""
    e = R.table(spark, d, "events").withColumn("k", F.concat(F.lit("k"), F.col("user_id").cast("string")))
    kinds = [["ping"], ["PING", F.col("event_type")], ["mset", F.col("k"), F.col("event_type"), F.concat("k", F.lit("'")), F.col("event_type")], ["EXISTS", F.col("k"), F.col("k"), F.lit("absent")], ["COMMAND"], ["bogus", F.col("k")], ["get"], ["Get", F.col("k")]]
    words = F.coalesce(*[F.when(F.col("event_id") % 8 == i, F.array(*[F.lit(x) if isinstance(x, str) else x for x in k])) for i, k in enumerate(kinds)])
    return commands.run_commands(resp.parse_commands(e.select(F.col("event_id").alias("pos"), codecs.utf8(codecs.resp_array(words)).alias("data")))).select("pos", "reply")


@query("SELECT run, seq, CASE WHEN lag(seq) OVER (PARTITION BY run ORDER BY seq) IS NULL THEN 0 ELSE seq - lag(seq) OVER (PARTITION BY run ORDER BY seq) END AS step FROM log", R.LOG_SQL)
def log_gaps(spark, d):
    placed = with_last_before(R.log(spark, d).select("run", "seq"), "run", "seq", F.col("seq"), "before")
    return placed.select("run", "seq", F.coalesce(F.col("seq") - F.col("before"), F.lit(0)).alias("step"))


# Stores and files: written to the shared folder and read back

_ROWS_SQL = "SELECT key, value, seq, tombstone FROM log"


WAL_SPAN = 4096


@query(_ROWS_SQL, R.LOG_SQL)
def wal_files(spark, d):
    """The log as files of spans of seq, and read back."""
    folder = scratch_path(spark, "wal")
    log_source.append_spans(R.log(spark, d), folder, "log.wal", WAL_SPAN)
    return log_source.read(spark, folder).select("key", "value", "seq", "tombstone")


@query(f"SELECT key, value, seq, tombstone FROM (SELECT *, min(CASE WHEN seq % 1000 = 777 THEN seq END) OVER (PARTITION BY seq // {WAL_SPAN}) AS hurt FROM log) WHERE hurt IS NULL OR seq < hurt", R.LOG_SQL)
def wal_damaged(spark, d):
    """The same files, with the checksum of each thousandth entry wrong: of every file the entries before the first such one."""
    folder = scratch_path(spark, "wal")
    entry = F.when(F.col("seq") % 1000 == 777, F.concat(F.substring("entry", F.lit(1), F.octet_length("entry") - 4), F.unhex(F.lit("00C0FFEE")))).otherwise(F.col("entry"))
    hurt = log_source.encoded(R.log(spark, d)).withColumn("entry", entry)
    files.write_spans(hurt, ["entry"], lambda rows: b"".join(r[0] for r in rows), folder, "log.wal", "seq", WAL_SPAN)
    return log_source.read(spark, folder).select("key", "value", "seq", "tombstone")


@query("SELECT key, value, seq, tombstone FROM resolved", R.STATE_SQL)
def run_files(spark, d):
    folder = scratch_path(spark, "runs")
    runs.write(resolve.newest(R.log(spark, d).drop("run", "expire_at")), folder, 4)
    return runs.read(spark, folder).select("key", "value", "seq", "tombstone")


@query("SELECT key, value FROM view", R.STATE_SQL)
def snapshot_files(spark, d):
    folder = scratch_path(spark, "snapshot")
    snapshot.write(resolve.view(R.log(spark, d)), folder, "view.snap", 4)
    return snapshot.read(spark, folder)


def _lake(spark, d):
    lake = Lake(spark, scratch_path(spark, "lake"))
    for i in range(R.RUNS):
        lake.append(R.log(spark, d).where(F.col("run") == i).drop("run"))
    return lake


@query("SELECT key, value, seq, expire_at FROM resolved WHERE NOT tombstone", R.STATE_SQL)
def lake_compacted(spark, d):
    """Two of four runs merged, then all of them."""
    lake = _lake(spark, d)
    lake.compact(major=False, names=lake.manifest()["runs"][1:3])
    lake.compact()
    return lake.entries().select("key", "value", "seq", "expire_at")


@query("SELECT key, value FROM view WHERE key >= 'user:000040' AND key < 'user:00009'", R.STATE_SQL)
def lake_scan_range(spark, d):
    return _lake(spark, d).scan_range("user:000040", "user:00009")


@query("SELECT key, value FROM view", R.STATE_SQL)
def lake_snapshot(spark, d):
    target = scratch_path(spark, "lake-snapshot")
    _lake(spark, d).snapshot(target)
    return read_snapshot(spark, target)


@query(f"SELECT key, value FROM resolved WHERE NOT tombstone AND (expire_at IS NULL OR expire_at > {AS_OF})", R.STATE_SQL)
def lake_evicted(spark, d):
    lake = _lake(spark, d)
    lake.evict(AS_OF)
    return lake.view()


@query("SELECT key, value, seq, tombstone, expire_at FROM resolved", R.STATE_SQL)
def stream_latest(spark, d):
    """The newest versions kept by a stream over the events' files, until all are read."""
    schema = R.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    folder = scratch_path(spark, "latest")
    views.into_folder(views.latest(R.mutations(events).drop("run")), folder, scratch_path(spark, "stream")).start().awaitTermination()
    return views.from_folder(spark, folder).select("key", "value", "seq", "tombstone", "expire_at")


# More of the inventory

@query("SELECT key, CASE WHEN a.seq IS NULL OR b.seq > a.seq THEN coalesce(b.seq, a.seq) ELSE a.seq END AS seq FROM (SELECT key, max(seq) AS seq FROM log WHERE run < 2 GROUP BY key) a FULL JOIN (SELECT key, max(seq) AS seq FROM log WHERE run >= 2 GROUP BY key) b USING (key)", R.LOG_SQL)
def kv_resolve_two(spark, d):
    """Two halves of the log, resolved apart and then with each other."""
    side = lambda i: resolve.newest(R.log(spark, d).where(F.floor(F.col("run") / 2) == i).select("key", "value", "seq")).select("key", F.struct("seq", "value").alias(f"v{i}"))
    both = side(0).join(side(1), "key", "full")
    return both.select("key", resolve.either(F.col("v0"), F.col("v1"))["seq"].alias("seq"))


@query("SELECT key, value FROM view WHERE false", R.STATE_SQL)
def kv_clear(spark, d):
    view = resolve.view(R.log(spark, d))
    gone = batch.deletes(view.select("key"), 1 << 40).select("key", "value", "seq", "tombstone")
    return resolve.view(batch.appended(R.log(spark, d).select("key", "value", "seq", "tombstone"), gone))


@query(f"SELECT key, seq + 1 AS seq, true AS tombstone FROM resolved WHERE NOT tombstone AND expire_at <= {AS_OF}", R.STATE_SQL)
def kv_ttl_evictions(spark, d):
    live = resolve.live(resolve.newest(R.log(spark, d).drop("run")))
    return ttl.evictions(live, AS_OF).select("key", "seq", "tombstone")


@query("SELECT event_id AS i, event_id % 5 < 4 AS blank FROM events")
def kv_blank_keys(spark, d):
    keys_ = F.array(F.lit(None).cast("string"), F.lit(""), F.lit(" "), F.lit("\t\n"), F.concat(F.lit(" "), "event_type"))
    return R.table(spark, d, "events").select(F.col("event_id").alias("i"), keys.is_blank(F.element_at(keys_, (F.col("event_id") % 5 + 1).cast("int"))).alias("blank"))


@query("SELECT seq, key, value FROM log WHERE seq > (SELECT max(seq) // 2 FROM log)", R.LOG_SQL)
def wal_compacted(spark, d):
    """The log once a snapshot holds its first half."""
    own = R.log(spark, d)
    half = (own.agg(F.max("seq")).first()[0] or 0) // 2
    return log_source.compacted(own, half).select("seq", "key", "value")


@query("""SELECT event_id AS pos, CASE WHEN event_id % 3 = 0 THEN 405 WHEN event_type = 'view' THEN 200 ELSE 404 END AS code, CASE WHEN event_id % 3 <> 0 AND event_type = 'view' THEN (SELECT '{"total":' || count(*) || ',"active":' || count(*) FILTER (status = 'ACTIVE') || '}' FROM members) END AS body FROM events""", _MEMBER_EVENTS_SQL)
def admin_replies(spark, d):
    requests = R.table(spark, d, "events").select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 == 0, "post").otherwise("get").alias("method"), F.concat(F.lit("/"), "event_type").alias("path"))
    return membership.admin_reply(requests, membership.status_json(_members(spark, d)).select(F.lit("/view").alias("path"), "body"))


@query("SELECT count(*) AS pending FROM missed", _HINTS_SQL)
def hints_total(spark, d):
    return quorum.total_pending(_hints(spark, d))


@query("SELECT key, count(u.node_id) AS acks, count(u.node_id) >= 3 AS ok FROM placement LEFT JOIN up u USING (node_id) WHERE key IN (SELECT key FROM log WHERE tombstone) GROUP BY key", _REPLICAS_SQL + _UP_SQL)
def quorum_delete(spark, d):
    gone = R.log(spark, d).where("tombstone").select("key").distinct()
    placed = ring.replica_rows(gone, ring.tokens(R.nodes(spark, 5)), 3)
    return quorum.acks(placed, _up(spark), quorum.Quorum(3, 3, 1))


@query("SELECT o AS observer, count(*) AS entries, max(version) AS newest FROM d GROUP BY o", _GOSSIP_SQL)
def gossip_digest(spark, d):
    return _digests(spark, d).groupBy(F.col("o").alias("observer")).agg(F.count("*").alias("entries"), F.max("version").alias("newest"))


@query("SELECT 'n' AS node_id, max(index) AS last_index, arg_max(term, index) AS last_term FROM leader UNION ALL SELECT 'empty', 0, 0", _RAFT_SQL)
def raft_tail(spark, d):
    return raftlog.tail(_leader(spark, d).withColumn("node_id", F.lit("n")), spark.createDataFrame([("n",), ("empty",)], "node_id string"))


@query("SELECT 'n' AS node_id, w.index, w.term, w.index = 0 OR l.index IS NOT NULL AS found FROM (SELECT index, CASE WHEN index % 2 = 0 THEN term ELSE term + 1 END AS term FROM leader UNION ALL SELECT 0, 0) w LEFT JOIN leader l ON l.index = w.index AND l.term = w.term", _RAFT_SQL)
def raft_contains(spark, d):
    own = _leader(spark, d).withColumn("node_id", F.lit("n"))
    wanted = own.select("node_id", "index", F.when(F.col("index") % 2 == 0, F.col("term")).otherwise(F.col("term") + 1).alias("term"))
    return raftlog.contains(own, wanted.unionByName(spark.createDataFrame([("n", 0, 0)], "node_id string, index long, term long")))


@query("SELECT index, term FROM leader WHERE index < 250", _RAFT_SQL)
def raft_truncated(spark, d):
    return raftlog.truncated(_leader(spark, d), 250).select("index", "term")


@query("SELECT index FROM leader WHERE index % 10 = 1 AND index > 1", _RAFT_SQL)
def raft_gaps(spark, d):
    own = _leader(spark, d).withColumn("node_id", F.lit("n")).where("index % 10 <> 0")
    return raftlog.gaps(own).select("index")


@query("SELECT event_id AS pos, event_id % 4 > 2 OR event_id % 4 = 2 AND user_id >= 5 AS granted FROM events")
def raft_up_to_date(spark, d):
    """Candidates' logs against a voter's that ends at (term 2, index 5)."""
    term, index = F.col("event_id") % 4, F.col("user_id")
    return R.table(spark, d, "events").select(F.col("event_id").alias("pos"), raftlog.at_least_as_new(term, index, F.lit(2), F.lit(5)).alias("granted"))


@query("SELECT 'body' AS kind, '[' || string_agg('{\"nodeId\":\"' || node_id || '\",\"host\":\"h\",\"port\":1,\"status\":\"ACTIVE\"}', ',' ORDER BY node_id) || ']' AS body FROM members WHERE status = 'ACTIVE'", _MEMBER_EVENTS_SQL)
def admin_nodes(spark, d):
    named = _members(spark, d).withColumn("host", F.lit("h")).withColumn("port", F.lit(1))
    return membership.nodes_json(named).select(F.lit("body").alias("kind"), "body")
