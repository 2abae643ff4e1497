import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import ring_token, token_of
from tidemark.operators import membership, metrics, quorum, raftlog, ring


def names(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def keys(spark, *ks):
    return spark.createDataFrame([(k,) for k in ks], "key string")


def walk(tokens, key, n):
    """Replicas by hand: sorted tokens, clockwise."""
    t, order = token_of(key), sorted(tokens)
    start = next((i for i, (tok, _) in enumerate(order) if tok >= t), 0)
    found = []
    for tok, node in order[start:] + order[:start]:
        if node not in found:
            found.append(node)
    return found[:n]


def test_tokens(spark):
    assert token_of("node1#vn0") == 6037311383238644000
    labels = [f"é{i}" for i in range(50)]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(ring_token(F.col("l"))).collect()] == [token_of(x) for x in labels]
    assert ring.tokens(names(spark, "a", "a", "b"), 10).count() == 20


@pytest.mark.parametrize("n, vnodes", [(1, 1), (2, 3), (3, 10), (5, 40)])
def test_placement_equals_a_walk(spark, n, vnodes):
    own = ring.tokens(names(spark, *[f"n{i}" for i in range(n)]), vnodes)
    tokens = [(r.token, r.node_id) for r in own.collect()]
    ks = [f"key:{i}" for i in range(400)]
    assert {r.key: r.node_id for r in ring.primary(keys(spark, *ks), own).collect()} == {k: walk(tokens, k, 1)[0] for k in ks}
    assert {r.key: r.replicas for r in ring.replicas(keys(spark, *ks), own, 3).collect()} == {k: walk(tokens, k, 3) for k in ks}
    if n == 3:
        assert {r.node_id for r in ring.primary(keys(spark, *ks), own).collect()} == {"n0", "n1", "n2"}


def test_empty_ring(spark):
    empty = ring.tokens(names(spark), 10)
    assert ring.primary(keys(spark, "a"), empty).count() == 0 and ring.replicas(keys(spark, "a"), empty, 3).count() == 0
    with pytest.raises(ValueError):
        ring.replica_lists(empty, 0)


def test_a_new_node_moves_some_keys(spark):
    ks = keys(spark, *[f"k{i}" for i in range(1000)])
    row = ring.remap_fraction(ks, ring.tokens(names(spark, "n1", "n2")), ring.tokens(names(spark, "n1", "n2", "n3"))).first()
    assert row.keys == 1000 and 0.1 <= row.fraction <= 0.6


def test_rebalance(spark):
    stores = spark.createDataFrame([("nodeA", f"key-{i}", str(i)) for i in range(100)], "node_id string, key string, value string")
    after = ring.tokens(names(spark, "nodeA", "nodeB"))
    moves = ring.moves_on_join(stores, after, "nodeB").collect()
    owned = {r.key for r in ring.primary(stores.select("key"), after).where("node_id = 'nodeB'").collect()}
    assert {m.key for m in moves} == owned and 0 < len(owned) < 100 and {(m.source, m.target) for m in moves} == {("nodeA", "nodeB")}
    left = ring.moves_on_leave(stores, ring.without(after, "nodeA"), "nodeA").collect()
    assert len(left) == 100 and {m.target for m in left} == {"nodeB"}


def state(spark, rows):
    return spark.createDataFrame([(n, "k", v, s, v is None) for n, v, s in rows], "node_id string, key string, value string, seq long, tombstone boolean")


PLACED = [("k", 0, "A"), ("k", 1, "B"), ("k", 2, "C")]


def placement(spark, rows=PLACED):
    return spark.createDataFrame(rows, "key string, replica_pos int, node_id string")


def test_quorum_configuration():
    assert quorum.Quorum() == quorum.Quorum(3, 2, 2) and quorum.Quorum().strong and not quorum.Quorum(3, 1, 1).strong
    for bad in ((3, 0, 2), (3, 4, 2), (3, 2, 0), (0, 1, 1)):
        with pytest.raises(ValueError):
            quorum.Quorum(*bad)


def test_quorum_write_and_read(spark):
    ok = lambda *up: quorum.acks(placement(spark), names(spark, *up), quorum.Quorum()).first()
    assert ok("A", "C").ok and ok("A", "C").acks == 2 and not ok("B").ok
    held = state(spark, [("A", "old", 1), ("B", "new", 2), ("C", "newest", 3)])
    read = lambda first, *up: quorum.read(placement(spark), names(spark, *up), held, quorum.Quorum(), first).collect()
    assert [r.value for r in read(False, "A", "B", "C")] == ["new"] and [r.value for r in read(True, "A", "B", "C")] == ["old"]
    assert [r.value for r in read(False, "A", "C")] == ["newest"] and read(False, "C") == []
    deleted = state(spark, [("A", "old", 1), ("B", None, 2)])
    assert quorum.read(placement(spark), names(spark, "A", "B"), deleted, quorum.Quorum()).count() == 0


@pytest.mark.parametrize(
    "held, want",
    [
        ([("A", "new-val", 10), ("B", "old-val", 3)], {"B": "new-val", "C": "new-val"}),
        ([("A", "hello", 5), ("C", "hello", 5)], {"B": "hello"}),
        ([("A", None, 20), ("B", "old", 2), ("C", None, 20)], {"B": None}),
        ([("A", "v", 7), ("B", "v", 7), ("C", "v", 7)], {}),
        ([], {}),
        ([("A", "v", 7), ("B", "v", 7), ("C", "v", 7), ("elsewhere", "w", 9)], {}),
    ],
)
def test_read_repair(spark, held, want):
    own = state(spark, held)
    assert {r.node_id: r.value for r in quorum.repairs(placement(spark), own).collect()} == want
    after = quorum.repaired(placement(spark), own)
    assert quorum.repairs(placement(spark), after).count() == 0


def test_hints(spark):
    mutations = spark.createDataFrame([("k", "v", 5, False)], "key string, value string, seq long, tombstone boolean")
    missed = quorum.hints(placement(spark), names(spark, "A"), mutations)
    assert sorted((r.target, r.op, r.seq) for r in missed.collect()) == [("B", "PUT", 5), ("C", "PUT", 5)]
    members = spark.createDataFrame([("B", "ACTIVE"), ("C", "DOWN")], "node_id string, status string")
    assert {r.target: r.pending for r in quorum.pending(missed).collect()} == {"B": 1, "C": 1} and quorum.total_pending(missed).first().pending == 2
    assert [r.target for r in quorum.deliverable(missed, members).collect()] == ["B"] and [r.target for r in quorum.remaining(missed, members).collect()] == ["C"]
    after = quorum.replayed(state(spark, [("A", "v", 5), ("B", "newer", 9)]), missed, members)
    assert {r.node_id: r.value for r in after.collect()} == {"A": "v", "B": "newer"}  # an old hint undoes nothing
    aged = missed.withColumn("hint_ts", F.when(F.col("target") == "B", 0).otherwise(20_000_000).cast("long"))
    assert [r.target for r in quorum.fresh(aged, 21_000_000).collect()] == ["C"]


def test_members(spark):
    events = [("node1", "join"), ("node2", "join"), ("node3", "join"), ("node2", "suspect"), ("node3", "down"), ("node4", "suspect"), ("node5", "join"), ("node5", "leave"), ("node5", "down")]
    df = membership.members(spark.createDataFrame([(n, e, i) for i, (n, e) in enumerate(events)], "node_id string, event string, seq int"))
    assert {r.node_id: r.status for r in df.collect()} == {"node1": "ACTIVE", "node2": "SUSPECT", "node3": "DOWN"}
    assert membership.active(df).count() == 1
    named = df.withColumn("host", F.lit("h")).withColumn("port", F.lit(7))
    assert membership.nodes_json(named).first().body == '[{"nodeId":"node1","host":"h","port":7,"status":"ACTIVE"}]'
    assert membership.health_json(df.limit(0)).first().body == '{"status":"DEGRADED","activeNodes":0}'


def test_failure_detection(spark):
    beats = spark.createDataFrame([("a", 0), ("a", 900), ("b", 750), ("c", 100)], "node_id string, ts long")
    rows = {r.node_id: (r.elapsed_ms, r.status) for r in membership.detect(names(spark, "a", "b", "c", "d"), beats, 1000, 100, 300).collect()}
    assert rows == {"a": (100, "SUSPECT"), "b": (250, "SUSPECT"), "c": (900, "DOWN"), "d": (-1, "ACTIVE")}


def digest(spark, *rows):
    return spark.createDataFrame(rows, "node_id string, status string, version long")


def test_gossip(spark):
    own = digest(spark, ("nodeA", "ACTIVE", 1))
    newer, older = digest(spark, ("nodeA", "SUSPECT", 5)), digest(spark, ("nodeA", "DOWN", 1))
    merged = membership.gossip_merge(own, newer)
    assert merged.first().status == "SUSPECT" and membership.gossip_updates(own, newer).first().updated == 1
    assert membership.gossip_merge(own, older).first().status == "ACTIVE" and membership.gossip_updates(own, older).first().updated == 0
    assert membership.gossip_updates(merged, newer).first().updated == 0
    state_ = spark.createDataFrame([(f"n{i}", f"n{i}", "ACTIVE", 0) for i in range(3)], "observer string, node_id string, status string, version long")
    mesh = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(3) for j in range(3) if i != j], "src string, dst string")
    assert not membership.converged(membership.gossip_round(state_, mesh.limit(1))).first().converged
    after = membership.gossip(state_, [mesh])
    assert after.count() == 9 and membership.converged(after).first().converged


def raft(spark, rows):
    return spark.createDataFrame([("n", i, t, "Put", "k", v) for i, t, v in rows], "node_id string, index long, term long, cmd string, key string, value string")


def test_raft_log(spark):
    own = raft(spark, [(1, 1, "a"), (2, 1, "b"), (3, 2, "c")])
    assert raftlog.tail(own, names(spark, "n", "empty")).orderBy("node_id").collect()[1][1:] == (3, 2)
    assert [r["index"] for r in raftlog.truncated(own, 2).collect()] == [1]
    with pytest.raises(ValueError):
        raftlog.truncated(own, 0)
    five = raft(spark, [(i, 1, "v") for i in range(1, 6)])
    assert sorted(r["index"] for r in raftlog.part(five, 2, 4).collect()) == [2, 3] and raftlog.gaps(five).count() == 0
    assert [r["index"] for r in raftlog.gaps(five.where("index <> 3")).collect()] == [4]
    wanted = spark.createDataFrame([("n", 0, 0), ("n", 3, 2), ("n", 3, 1), ("n", 9, 1)], "node_id string, index long, term long")
    assert [r.found for r in raftlog.contains(own, wanted).orderBy("index", "term").collect()] == [True, False, True, False]


@pytest.mark.parametrize(
    "follower, leader, prev, want",
    [
        ([(1, 1, "bad")], [(1, 2, "good")], (0, 0), [(1, 2, "good")]),
        ([(1, 1, "a")], [(1, 1, "a"), (2, 1, "b")], (1, 1), [(1, 1, "a"), (2, 1, "b")]),
        ([(1, 1, "a")], [(1, 2, "z"), (2, 2, "b")], (1, 2), [(1, 1, "a")]),
        ([(1, 1, "a"), (2, 1, "x"), (3, 1, "y")], [(1, 1, "a"), (2, 2, "b")], (1, 1), [(1, 1, "a"), (2, 2, "b")]),
        ([(1, 1, "a"), (2, 1, "b"), (3, 1, "c")], [(1, 1, "a"), (2, 1, "b")], (1, 1), [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]),
        ([], [(1, 1, "a")], (0, 0), [(1, 1, "a")]),
    ],
)
def test_append_entries(spark, follower, leader, prev, want):
    got = raftlog.appended(raft(spark, follower), raft(spark, leader), *prev)
    assert sorted((r["index"], r.term, r.value) for r in got.collect()) == want


def test_commit_and_fold(spark):
    leader = raft(spark, [(1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, 2, "d")])
    matches = lambda *m: spark.createDataFrame([(f"n{i}", x) for i, x in enumerate(m)], "node_id string, match_index long")
    assert raftlog.commit_index(matches(4, 3, 1), leader, 2).first().commit_index == 3
    assert raftlog.commit_index(matches(4, 2, 1), leader, 2, 1).first().commit_index == 1  # a majority, but of an older term
    assert raftlog.commit_index(matches(4, 4, 3, 3), leader, 2).first().commit_index == 3
    log = spark.createDataFrame([(1, "Put", "k", "a"), (2, "Put", "k", "b"), (3, "NoOp", None, None), (4, "Put", "x", "1"), (5, "Delete", "x", None), (6, "Put", "late", "1")], "index long, cmd string, key string, value string")
    assert {r.key: r.value for r in raftlog.fold(log, 5).collect()} == {"k": "b"}


def test_metrics(spark):
    added = spark.createDataFrame([("c", 1), ("c", 1), ("c", 3)], "name string, delta long")
    assert metrics.counters(added).first().value == 5 and metrics.value_of(metrics.counters(added), "none").first().value == 0
    set_ = spark.createDataFrame([("g", 42, 1), ("g", 7, 2)], "name string, value long, ts long")
    assert metrics.gauges(set_).first().value == 7
    seen = spark.createDataFrame([("h", 2), ("h", 4), ("h", 7)], "name string, value_ms long")
    assert {r.le: r.bucket for r in metrics.histogram(seen).collect()} == {"1": 0, "5": 2, "10": 3, "50": 3, "100": 3, "500": 3, "1000": 3, "+Inf": 3}
    body = metrics.scrape_text(metrics.scrape(metrics.counters(added), metrics.gauges(set_), spark.createDataFrame([("lat", 5)], "name string, value_ms long"))).first().body
    assert body.startswith("# TYPE c counter\nc 5\n# TYPE g gauge\ng 7\n# TYPE lat histogram\n")
    assert 'lat_bucket{le="+Inf"} 1\n' in body and body.endswith("lat_count 1\nlat_sum 5\n")
