import types

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import raftlog
from tidemark.plans import session
from tidemark.sources.client import Client, ReplyError, Store
from tidemark.sources.lake import Lake


def test_a_lake_is_a_store(spark, tmp_path):
    assert isinstance(Lake(spark, str(tmp_path)), Store) and not isinstance({}, Store)


def test_client_replies(spark):
    client = Client(spark)
    for words in (["ping"], ["SET", "k", "é𝄞"], ["GET", "k"], ["mset", "a", "1", "b", ""], ["MGET", "a", "x", "b"], ["EXISTS", "a", "a", "x"], ["DEL", "a"], ["GET", "a"], ["NOPE"], ["GET"], ["COMMAND"]):
        client.send(*words)
    *replies, unknown, wrong, stub = client.flush()
    assert replies == ["PONG", "OK", "é𝄞", "OK", ["1", None, ""], 2, 1, None] and stub == "OK"
    assert isinstance(unknown, ReplyError) and "NOPE" in str(unknown) and isinstance(wrong, ReplyError)
    assert client.flush() == [] and client.queue == []
    client.send("bad")
    with pytest.raises(ReplyError):
        client.flush(strict=True)
    with pytest.raises(ValueError):
        client.send()


def test_rounds_of_replication(spark):
    rows = [("l", i, 1 if i < 4 else 3, "Put", f"k{i}", "x") for i in range(1, 8)]
    rows += [("same", i, 1, "Put", f"k{i}", "x") for i in range(1, 3)] + [("split", i, 1 if i < 4 else 2, "Put", f"o{i}", "y") for i in range(1, 6)]
    rows += [("cut off", 1, 1, "Put", "k1", "x")] + [("longer", i, 1 if i < 4 else 3, "Put", f"k{i}", "x") for i in range(1, 10)]
    logs = spark.createDataFrame(rows, "node_id string, index long, term long, cmd string, key string, value string")
    reached = spark.createDataFrame([("same",), ("split",), ("longer",), ("empty",), ("l",)], "node_id string")
    after = raftlog.replicated(logs, "l", reached)
    got = {}
    for r in after.collect():
        got.setdefault(r.node_id, []).append((r["index"], r.term, r.key))
    own = [(i, 1 if i < 4 else 3, f"k{i}") for i in range(1, 10)]
    for x in got.values():
        x.sort()
    assert got["l"] == got["same"] == got["empty"] == own[:7] and got["longer"] == own and got["cut off"] == own[:1]
    assert [x[1] for x in got["split"]] == [1, 1, 1, 3, 3, 3, 3]
    matches = {r.node_id: r.match_index for r in raftlog.matched(after, "l").collect()}
    assert matches == {"l": 7, "same": 7, "empty": 7, "split": 7, "longer": 7, "cut off": 1}
    before = {r.node_id: r.match_index for r in raftlog.matched(logs, "l").collect()}
    assert before == {"l": 7, "same": 2, "split": 3, "longer": 7, "cut off": 1}
    grown = raftlog.proposed(logs.where("node_id = 'l'"), spark.createDataFrame([(9, "Put", "b", "2"), (4, "Delete", "a", None)], "pos int, cmd string, key string, value string"), 5)
    assert sorted((r["index"], r.term, r.key) for r in grown.where("index > 7").collect()) == [(8, 5, "a"), (9, 5, "b")]


def test_a_cluster_needs_a_shared_folder():
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)


def test_only_absent_parts_are_left_out():
    assert not __spark_entry__._there("tidemark.nothing.queries") and not __spark_entry__._there("no_such_module") and __spark_entry__._there("tidemark.plans.session")


def test_elections_terms_and_who_may_write(spark):
    nodes = spark.createDataFrame([("a", "LEADER", 3, 0), ("b", "FOLLOWER", 3, 0), ("c", "FOLLOWER", 2, 900), ("d", "CANDIDATE", 1, 0)], "node_id string, role string, term long, heard long")
    due = {(r.candidate, r.term) for r in raftlog.elections_due(nodes, 1000).collect()}
    assert due == {("b", 4), ("d", 2)} and raftlog.elections_due(nodes, 149).count() == 0
    waits = [r[0] for r in spark.range(500).select(raftlog.timeout_ms(F.col("id").cast("string"), F.lit(1))).collect()]
    assert 150 <= min(waits) < 160 and 290 < max(waits) < 300
    messages = spark.createDataFrame([("a", 5), ("a", 4), ("b", 3), ("x", 9)], "node_id string, term long")
    assert {r.node_id: (r.role, r.term) for r in raftlog.stepped_down(nodes, messages).collect()} == {"a": ("FOLLOWER", 5), "b": ("FOLLOWER", 3), "c": ("FOLLOWER", 2), "d": ("CANDIDATE", 1)}
    requests = spark.createDataFrame([(0, "a", "PUT"), (1, "b", "PUT"), (2, "b", "GET"), (3, "zz", "GET")], "pos int, node_id string, op string")
    got = {r.pos: (r.status, r.leader) for r in raftlog.admitted(requests, nodes).collect()}
    assert got == {0: ("OK", None), 1: ("NOT_LEADER", "a"), 2: ("OK", None), 3: ("UNKNOWN_NODE", None)}
    nobody = raftlog.admitted(requests, nodes.where("node_id = 'b'")).collect()
    assert {r.pos: (r.status, r.leader) for r in nobody}[1] == ("NOT_LEADER", None)


def test_partition_and_heal(spark):
    edges = spark.createDataFrame([(a, b) for a in "lmn" for b in "lmn" if a != b], "src string, dst string")
    logs = spark.createDataFrame([("l", 1, 1, "Put", "k", "v"), ("l", 2, 1, "Put", "k2", "v")], "node_id string, index long, term long, cmd string, key string, value string")
    parted = raftlog.replicated(logs, "l", raftlog.reached(edges, "l", spark.createDataFrame([("l", "n")], "src string, dst string")))
    assert {r.node_id: r["count"] for r in parted.groupBy("node_id").count().collect()} == {"l": 2, "m": 2}
    assert raftlog.replicated(parted, "l", raftlog.reached(edges, "l")).groupBy("node_id").count().where("count = 2").count() == 3
