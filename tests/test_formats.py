import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import bloom, codecs, hashing, resp
from tidemark.operators import commands, resolve
from tidemark.sources import log, runs, snapshot

TEXT = st.text(max_size=30).filter(lambda s: "\ud800" not in s)


def mutations(spark, rows):
    return spark.createDataFrame([(k, v, s, v is None) for k, v, s in rows], "key string, value string, seq long, tombstone boolean")


# Log

def test_log_entry_bytes(spark):
    rows = [("user:1", "Alice", 42), ("gone-key", None, 99), ("cleé", "valüe𝄞", 2**62), ("e", "", 1)]
    got = {r.seq: bytes(r.entry) for r in log.encoded(mutations(spark, rows)).collect()}
    for k, v, s in rows:
        body = struct.pack(">qbi", s, 1 if v is not None else 2, len(k.encode())) + k.encode() + struct.pack(">i", len((v or "").encode())) + (v or "").encode()
        assert got[s] == body + struct.pack(">I", zlib.crc32(body)) == log.encode(s, "PUT" if v is not None else "DELETE", k, v or "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**63 - 1), st.sampled_from(["PUT", "DELETE"]), TEXT.filter(bool), TEXT), max_size=6), st.integers(0, 400))
def test_log_prefix(entries, cut):
    data = b"".join(log.encode(*e) for e in entries)
    assert list(log.replay(data)) == entries
    torn = data[: max(0, len(data) - cut)]
    got = list(log.replay(torn))
    assert got == entries[: len(got)] and (cut == 0 or len(got) < len(entries) or not entries)


def test_log_stops_at_damage():
    data = bytearray(b"".join(log.encode(i, "PUT", f"k{i}", "value") for i in range(3)))
    size = len(data) // 3
    data[size + 20] ^= 1
    assert [e[0] for e in log.replay(bytes(data))] == [0]
    with pytest.raises(log.CorruptEntry):
        log.decode(bytes(data), size)
    assert list(log.replay(b"")) == [] and list(log.replay(bytes(21))) == []


def test_log_files(spark, tmp_path):
    folder = str(tmp_path / "wal")
    assert log.append(mutations(spark, [("kept-1", "yes", 1), ("gone", "x", 2), ("kept-2", "42", 3)]), folder, "0001.wal") == 1
    log.append(mutations(spark, [("gone", None, 4)]), folder, "0002.wal")
    whole = (tmp_path / "wal/0002.wal").read_bytes()
    (tmp_path / "wal/0003.wal").write_bytes(whole + log.encode(5, "PUT", "torn", "v")[:-5])
    back = log.read(spark, folder)
    assert back.count() == 5
    assert {r.key: r.value for r in resolve.view(back).collect()} == {"kept-1": "yes", "kept-2": "42"}
    assert resolve.next_seq(back).first().next_seq == 5 and log.compacted(back, 3).count() == 2


# Runs

def test_run_round_trip():
    entries = [(f"key:{i:05d}", f"val:{i}", i, False) for i in range(200)] + [("deleted", None, 5, True), ("empty", "", 6, False)]
    run = runs.Run(runs.encode(entries, 7))
    assert list(run.entries()) == sorted(entries) and run.created_ms == 7 and len(run.keys) == 13
    for i in range(0, 200, 7):
        assert run.get(f"key:{i:05d}") == entries[i]
    assert run.get("deleted") == entries[200] and run.get("empty")[1] == "" and run.get("absent") is None and run.get("a") is None and run.get("zzz") is None
    assert list(runs.Run(runs.encode([])).entries()) == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(TEXT.filter(bool), st.tuples(st.none() | TEXT, st.integers(0, 2**40)), max_size=60))
def test_run_lookup(table):
    entries = [(k, v, s, v is None) for k, (v, s) in table.items()]
    run = runs.Run(runs.encode(entries))
    assert all(run.get(e[0]) == e for e in entries) and len(list(run.entries())) == len(entries)


def test_run_damage():
    data = runs.encode([("a", "1", 1, False)])
    for at in (0, 30, len(data) - 1, len(data) - 10):
        with pytest.raises(runs.CorruptRun):
            runs.Run(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(runs.CorruptRun):
        runs.Run(data[:10])


def test_run_files(spark, tmp_path):
    own = mutations(spark, [("tin", "z", 1), ("ash", "a", 2), ("oak", None, 3)])
    assert runs.write(own, str(tmp_path / "r"), partitions=2) >= 1
    got = runs.read(spark, str(tmp_path / "r"))
    assert {r.key: (r.value, r.seq, r.tombstone) for r in got.collect()} == {"tin": ("z", 1, False), "ash": ("a", 2, False), "oak": (None, 3, True)}
    index = runs.sparse_index(spark.range(100).select(F.format_string("k%03d", "id").alias("key")))
    assert sorted((r.n, r.key) for r in index.collect()) == [(i, f"k{i:03d}") for i in range(0, 100, 16)]


def test_lookup_in_overlapping_runs(spark, tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    tables = [{f"k{i:03d}": (f"{n}:{i}", i) for i in range(a, b, step)} for n, (a, b, step) in enumerate([(0, 200, 1), (50, 60, 1), (55, 900, 5), (10, 11, 1), (300, 400, 3)])]
    for n, t in enumerate(tables):
        (folder / f"{n}.sst").write_bytes(runs.encode([(k, v, s, False) for k, (v, s) in t.items()]))
    (folder / "none.sst").write_bytes(runs.encode([]))
    wanted = [f"k{i:03d}" for i in (*range(0, 999, 7), 10, 55, 895)] + ["", "zzz", None]
    got = sorted((r.key, r.value, r.seq) for r in runs.lookup(spark, str(folder), spark.createDataFrame([(k,) for k in wanted], "key string")).collect())
    assert got == sorted((k, *t[k]) for k in set(wanted) for t in tables if k in t for _ in range(wanted.count(k)))


# Frames

def test_frames_of_a_stream(spark):
    whole = b"".join(struct.pack(">i", len(x)) + x for x in (b"a", b"bc" * 300, "é𝄞".encode()))
    cases = [b"", whole, whole + b"\0\0", whole + struct.pack(">i", 9) + b"short", whole + struct.pack(">i", 0) + b"x", struct.pack(">i", -5) + whole, struct.pack(">i", (64 << 20) + 1), None]
    df = spark.createDataFrame(list(enumerate(cases)), "n int, c binary")
    got = {r.n: r.r for r in df.select("n", codecs.read_frames(F.col("c")).alias("r")).collect()}
    frames = [b"a", b"bc" * 300, "é𝄞".encode()]
    assert [list(map(bytes, got[i].frames)) for i in (1, 2, 3, 4)] == [frames] * 4 and list(got[0].frames) == list(got[5].frames) == []
    assert [bytes(got[i].rest) for i in (0, 1, 2, 3)] == [b"", b"", b"\0\0", struct.pack(">i", 9) + b"short"]
    assert all(got[i].error is None for i in (0, 1, 2, 3)) and all("out of range" in got[i].error for i in (4, 5, 6))


# Snapshots

def test_log_in_spans_of_seq(spark, tmp_path):
    rows = [(f"k{i}", f"v{i}", i) for i in range(1, 2500)]
    assert log.append_spans(mutations(spark, rows).repartition(5), str(tmp_path / "w"), "a.wal", 1000) == 3
    assert sorted(p.name for p in (tmp_path / "w").glob("*.wal")) == [f"a-{i:012d}.wal" for i in range(3)]
    assert [e[0] for e in log.replay((tmp_path / "w/a-000000000001.wal").read_bytes())] == list(range(1000, 2000))
    assert sorted((r.key, r.value, r.seq) for r in log.read(spark, str(tmp_path / "w")).collect()) == sorted(rows)


def test_snapshots(spark, tmp_path):
    rows = [("alpha", "1"), ("beta", "2"), ("gamma", "")]
    data = snapshot.encode(rows)
    assert list(snapshot.decode(data)) == rows and list(snapshot.decode(snapshot.encode([]))) == []
    for at in (0, len(data) - 1):
        with pytest.raises(snapshot.CorruptSnapshot):
            list(snapshot.decode(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))
    snapshot.write(spark.createDataFrame(rows[::-1], "key string, value string"), str(tmp_path), "s.snap")
    assert (tmp_path / "s.snap").read_bytes() == data
    assert sorted((r.key, r.value) for r in snapshot.read(spark, str(tmp_path / "s.snap")).collect()) == rows
    many = spark.range(500).selectExpr("concat('k', id) as key", "'v' as value")
    assert snapshot.write(many, str(tmp_path / "parts"), "p.snap", parts=4) > 1 and snapshot.read(spark, str(tmp_path / "parts")).count() == 500
    assert snapshot.write(many.limit(0), str(tmp_path / "none"), "p.snap") == 0


# Checksums

def test_checksums(spark):
    df = spark.createDataFrame([(b"HEADERDATA", zlib.crc32(b"HEADERDATA"))], "c binary, x long")
    row = df.select(F.crc32(hashing.region(F.col("c"), 6, 4)).alias("r"), hashing.crc_matches(F.col("c"), F.col("x")).alias("ok")).first()
    assert row.r == zlib.crc32(b"DATA") and bytes(row.ok) == b"HEADERDATA"
    with pytest.raises(Exception, match="checksum mismatch: expected 0xdeadbeef"):
        df.select(hashing.crc_matches(F.col("c"), F.lit(0xDEADBEEF))).collect()


# Wire

def test_requests(spark):
    rows = [("PUT", "user:1", "Alice"), ("GET", "k", None), ("PUT", "cleé", "valüe"), ("PUT", "big", "x" * 10_000), ("DELETE", "k", None), ("EXISTS", "k", None)]
    df = spark.createDataFrame(rows, "op string, key string, value string")
    got = df.select(codecs.request(F.col("op"), F.col("key"), F.col("value")).alias("c")).select("c", codecs.read_request(F.col("c")).alias("r")).collect()
    assert [(r.r.op, r.r.key, r.r.value, r.r.error) for r in got] == [(*r, None) for r in rows]
    assert bytes(got[0].c) == b"\x01" + struct.pack(">i", 6) + b"user:1" + struct.pack(">i", 5) + b"Alice"
    bad = [b"\xff" + bytes(got[0].c)[1:], b"\x01" + struct.pack(">i", 1) + b"k" + struct.pack(">i", 0), b"\x02" + struct.pack(">i", 0) + struct.pack(">i", 0), b"\x02", bytes(got[0].c)[:-1]]
    errors = [r.r.error for r in spark.createDataFrame([(b,) for b in bad], "c binary").select(codecs.read_request(F.col("c")).alias("r")).collect()]
    assert errors == ["unknown opcode", "PUT needs a value", "key length out of range", "short request", "value length out of range"]
    with pytest.raises(Exception, match="unknown code"):
        df.select(codecs.request(F.lit("NONE"), F.col("key"), F.col("value"))).collect()


def test_responses_and_frames(spark):
    rows = [("OK", "hello"), ("OK", None), ("NOT_FOUND", None), ("ERROR", "disk full"), ("OK", "1"), ("INVALID_REQUEST", "é")]
    df = spark.createDataFrame(rows, "s string, p string").select(codecs.response(F.col("s"), F.col("p")).alias("c"))
    assert [tuple(r.r) for r in df.select(codecs.read_response(F.col("c")).alias("r")).collect()] == rows
    framed = df.select(codecs.frame(F.col("c")).alias("f"), "c").collect()
    assert all(bytes(r.f) == struct.pack(">i", len(r.c)) + bytes(r.c) for r in framed)
    with pytest.raises(Exception, match="frame length"):
        spark.createDataFrame([(b"",)], "c binary").select(codecs.frame(F.col("c"))).collect()


# RESP2

def test_resp_values():
    v = resp.parse(b"*3\r\n$3\r\nSET\r\n$1\r\nk\r\n$6\r\nv\xc3\xa9\r\n!\r\n")
    assert v.kind == "array" and [x.value for x in v.value] == ["SET", "k", "vé\r\n!"]
    assert resp.parse(b"$5\r\nhello\r\n").value == "hello" and resp.parse(b"$-1\r\n").kind == "null" and resp.parse(b"*-1\r\n").kind == "null"
    assert resp.parse(b":42\r\n").value == 42 and resp.parse(b"+OK\r\n") == resp.Value("simple", "OK") and resp.parse(b"-ERR x\r\n").kind == "error"
    for bad in (b"", b"?", b"$5\r\nhe", b"$x\r\n", b":1", b"*2\r\n:1\r\n"):
        with pytest.raises(resp.RespError):
            resp.parse(bad)


def ask(spark, *lines):
    rows = [(i, b"*%d\r\n" % len(w) + b"".join(b"$%d\r\n%s\r\n" % (len(x.encode()), x.encode()) for x in w) if isinstance(w, list) else w) for i, w in enumerate(lines)]
    df = resp.parse_commands(spark.createDataFrame(rows, "pos int, data binary"))
    return [r.reply for r in commands.run_commands(df).orderBy("pos").collect()]


def test_commands(spark):
    got = ask(
        spark, ["PING"], ["ping", "hé"], ["SET", "k", "value"], ["get", "k"], ["GET", "none"], ["MSET", "a", "1", "b", "2"], ["MGET", "a", "none", "a"], ["EXISTS", "a", "a", "none"], ["DEL", "a", "a", "b", "none"],
        ["EXISTS", "a"], ["SET", "a", "x", "EX", "5"], ["GET", "a"], ["COMMAND"], ["FLY"], ["GET"], ["SET", "k"], ["MSET", "a"], ["DEL"], b":1\r\n", b"*0\r\n", b"oops",
    )
    assert got[:13] == ["+PONG\r\n", "$3\r\nhé\r\n", "+OK\r\n", "$5\r\nvalue\r\n", "$-1\r\n", "+OK\r\n", "*3\r\n$1\r\n1\r\n$-1\r\n$1\r\n1\r\n", ":2\r\n", ":2\r\n", ":0\r\n", "+OK\r\n", "$1\r\nx\r\n", "+OK\r\n"]
    assert got[13:20] == ["-ERR unknown command 'FLY'\r\n", "-ERR GET requires key\r\n", "-ERR SET requires key value\r\n", "-ERR MSET requires key-value pairs\r\n", "-ERR DEL requires key\r\n", "-ERR expected array command\r\n", "-ERR empty command\r\n"]
    assert got[20].startswith("-ERR ")


def test_dispatch(spark):
    rows = [(0, "GET", "k", None), (1, "PUT", "k", "v"), (2, "GET", "k", None), (3, "EXISTS", "k", None), (4, "DELETE", "k", None), (5, "EXISTS", "k", None), (6, "GET", "k", None), (7, "PUT", "k", ""), (8, "GET", "k", None)]
    got = commands.dispatch(spark.createDataFrame(rows, "pos int, op string, key string, value string")).orderBy("pos").collect()
    assert [(r.status, r.payload) for r in got] == [("NOT_FOUND", None), ("OK", None), ("OK", "v"), ("OK", "1"), ("OK", None), ("OK", "0"), ("NOT_FOUND", None), ("OK", None), ("OK", "")]


# Bloom filters

def brute_mix(data, seed):
    m, h = (1 << 64) - 1, seed
    for b in data:
        h = (h ^ b) * 0xFF51AFD7ED558CCD & m
        h ^= h >> 33
    h ^= len(data)
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & m
    return h ^ h >> 33


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=20))
def test_bloom_hash(data):
    assert bloom.mix(data, bloom.SEEDS[0]).tolist() == [brute_mix(x, bloom.SEEDS[0]) for x in data]
    for i, x in enumerate(data):
        h1, h2 = (brute_mix(x, s) for s in bloom.SEEDS)
        signed = [((h1 + k * h2) + 2**63) % 2**64 - 2**63 for k in range(5)]
        assert bloom.positions(data, 9586, 5)[i].tolist() == [s % 9586 for s in signed]


def test_bloom_rates(spark):
    assert bloom.sizing(1000, 0.01) == (9586, 7)
    for bad in ((0, 0.1), (10, 0.0), (10, 1.0)):
        with pytest.raises(ValueError):
            bloom.sizing(*bad)
    keys = spark.range(0, 10_000, 1, 4).select(F.concat(F.lit("present:"), F.col("id").cast("string")).alias("key"))
    made = bytes(bloom.build(keys, 10_000, 0.01).first().bloom)
    assert bloom.Bloom.from_bytes(made).to_bytes() == made
    assert bloom.probe(keys, made).where("not maybe").count() == 0
    absent = keys.select(F.regexp_replace("key", "present", "absent").alias("key"))
    assert bloom.probe(absent, made).where("maybe").count() <= 300
    assert not bloom.Bloom(*bloom.sizing(10, 0.01)).might_contain([b"x"]).any()
