import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import batch, resolve, scan, ttl
from tidemark.sources import lake as lake_module
from tidemark.sources.lake import Conflict, Lake

SCAN = ["lamp/3", "lamp/7", "lamp/31", "bolt/4", "bolt/9", "cord/x", "cord/y", "~end"]


def log(spark, rows):
    """rows: (key, value or None for a tombstone, seq)."""
    return spark.createDataFrame([(k, v, s, v is None) for k, v, s in rows], "key string, value string, seq long, tombstone boolean")


def as_dict(df):
    return {r.key: r.value for r in df.collect()}


def keys_of(df):
    return [r.key for r in df.collect()]


@pytest.fixture(scope="module")
def scanned(spark):
    return spark.createDataFrame([(k, "v") for k in SCAN], "key string, value string")


def test_scans(scanned):
    assert keys_of(scan.prefix(scanned, "lamp/")) == ["lamp/3", "lamp/31", "lamp/7"]
    assert keys_of(scan.prefix(scanned, "")) == sorted(SCAN) and keys_of(scan.prefix(scanned, "lamps")) == []
    assert keys_of(scan.between(scanned, "bolt/", "cord/")) == ["bolt/4", "bolt/9"]
    assert keys_of(scan.between(scanned, "", "bolt/9")) == ["bolt/4"]
    assert keys_of(scan.between(scanned, "lamp/5", "")) == ["lamp/7", "~end"]
    assert keys_of(scan.between(scanned)) == sorted(SCAN)
    for low, high in (("m", "b"), ("m", "m")):
        with pytest.raises(ValueError):
            scan.between(scanned, low, high)
    assert scan.count(scanned).first().n == 8


def test_key_orders_differ_for_supplementary_characters(spark):
    df = spark.createDataFrame([("",), ("𝄞",), ("a",)], "key string")
    assert keys_of(scan.prefix(df, "")) == ["a", "", "𝄞"]
    assert keys_of(scan.prefix(df, "", order="utf16")) == ["a", "𝄞", ""]
    with pytest.raises(ValueError):
        keys.sort_key(F.col("key"), "other")


@pytest.mark.parametrize("key", [None, "", " ", "\t", "\n", " "])
def test_blank_keys_are_refused(spark, key):
    df = spark.createDataFrame([(key,)], "key string")
    assert df.select(keys.is_blank(F.col("key"))).first()[0]
    with pytest.raises(Exception, match="blank"):
        df.select(keys.valid_key(F.col("key"))).collect()
    with pytest.raises(ValueError):
        batch.mput(spark, {key: "v"}, 1)


def test_point_operations(spark):
    rows = [("env", "dev", 1), ("env", "prod", 2), ("empty", "", 3), ("gone", "x", 4), ("gone", None, 5), ("back", "x", 6), ("back", None, 7), ("back", "y", 8), ("never", None, 9)]
    view = resolve.view(log(spark, rows))
    assert as_dict(view) == {"env": "prod", "empty": "", "back": "y"}
    assert resolve.size(log(spark, rows)).first()["size"] == 3
    assert scan.get(view, "env").first().value == "prod" and scan.exists(view, "gone").first().found is False
    assert resolve.next_seq(log(spark, rows)).first().next_seq == 10 and resolve.next_seq(log(spark, [])).first().next_seq == 1
    facts = resolve.memtable(log(spark, [("k", "four", 1), ("é", None, 2)]), threshold=7).first()
    assert (facts.entries, facts.live, facts.bytes, facts.should_flush) == (2, 1, 7, True)


def test_resolution_rules(spark):
    versions = log(spark, [("k", "old", 5), ("k", "new", 10), ("k", "oldest", 1)])
    assert resolve.newest(versions).first().value == "new"
    assert resolve.newest(log(spark, [("k", "live", 5), ("k", None, 20)])).first().tombstone
    assert resolve.newest(log(spark, [])).count() == 0
    a, b = log(spark, [("k", "a", 5)]), log(spark, [("k", "b", 5)])
    assert resolve.merge(a, b).first().value == "a" and resolve.merge(b, a).first().value == "b"
    df = spark.createDataFrame([((5, "a"), (5, "b")), (None, (1, "b")), ((1, "a"), None), ((1, "a"), (2, "b"))], "a struct<seq:int,v:string>, b struct<seq:int,v:string>")
    assert [r.w.v for r in df.select(resolve.either(F.col("a"), F.col("b")).alias("w")).collect()] == ["a", "b", "a", "b"]


def test_resolution_ignores_order_and_splitting(spark):
    rng = random.Random(42)
    rows = [(f"k{rng.randrange(50)}", rng.choice([None, "x", "y"]), i) for i in range(600)]
    want = {r.key: (r.value, r.seq) for r in resolve.newest(log(spark, rows)).collect()}
    rng.shuffle(rows)
    parts = [log(spark, rows[i::3]) for i in range(3)]
    assert {r.key: (r.value, r.seq) for r in resolve.merge(*parts).collect()} == want
    twice = resolve.merge(resolve.merge(parts[0], parts[1]), parts[2])
    assert {r.key: (r.value, r.seq) for r in twice.collect()} == want
    assert as_dict(resolve.live(twice).select("key", "value")) == as_dict(resolve.view(log(spark, rows)))


def test_compaction(spark):
    minor = resolve.merge(log(spark, [("deleted-key", "old", 1)]), log(spark, [("deleted-key", None, 10)]))
    assert minor.first().tombstone and resolve.live(minor).count() == 0
    assert keys_of(resolve.live(log(spark, [("alive", "yes", 1), ("deleted", None, 2)]))) == ["alive"]
    with pytest.raises(ValueError):
        resolve.merge()


def test_batches(spark):
    own = batch.mput(spark, {"a": "1", "b": "2", "c": "3"}, 1)
    assert as_dict(resolve.view(own)) == {"a": "1", "b": "2", "c": "3"}
    view = resolve.view(batch.mput(spark, {"x": "10", "z": "1"}, 1))
    assert [(r.key, r.value) for r in scan.mget(view, scan.keys_frame(spark, ["z", "x", "gone", "x"])).collect()] == [("z", "1"), ("x", "10"), ("gone", None)]
    assert scan.mexists(view, scan.keys_frame(spark, ["x", "z"])).first().all_exist
    assert not scan.mexists(view, scan.keys_frame(spark, ["x", "missing"])).first().all_exist
    assert scan.mexists(view, spark.createDataFrame([], "pos int, key string")).first().all_exist
    assert as_dict(resolve.view(batch.appended(own, batch.mdelete(spark, ["a", "absent"], 10)))) == {"b": "2", "c": "3"}
    for empty in (lambda: batch.mput(spark, {}, 1), lambda: batch.mdelete(spark, [], 1), lambda: batch.mput(spark, {"k": None}, 1)):
        with pytest.raises(ValueError):
            empty()
    frame = spark.createDataFrame([("q", "2"), ("p", "1")], "key string, value string")
    assert [(r.key, r.seq) for r in batch.puts(frame, 5).orderBy("seq").collect()] == [("p", 5), ("q", 6)]
    assert resolve.view(batch.appended(batch.puts(frame, 5), batch.deletes(frame, 7))).count() == 0


def test_ttl(spark):
    rows = [("k", "v", None), ("x", "v", 50), ("y", "v", 5000)]
    entries = spark.createDataFrame(rows, "key string, value string, expire_at long")
    wanted = scan.keys_frame(spark, ["k", "x", "y", "absent"])
    left = lambda at: {r.key: r.ttl_ms for r in ttl.ttl(entries, wanted, at).collect()}
    assert left(0) == {"k": -1, "x": 50, "y": 5000, "absent": -2}
    assert left(60) == {"k": -1, "x": -2, "y": 4940, "absent": -2}
    assert sorted(keys_of(ttl.visible(entries, 49))) == ["k", "x", "y"] and sorted(keys_of(ttl.visible(entries, 50))) == ["k", "y"]
    facts = ttl.counts(entries, 60).first()
    assert (facts.visible, facts.expired) == (2, 1)
    for bad in (0, -1):
        with pytest.raises(ValueError):
            ttl.deadline(0, bad)
    log_ = entries.withColumn("seq", F.lit(1).cast("long")).withColumn("tombstone", F.lit(False))
    plain = spark.createDataFrame([("x", "again", 2, False)], "key string, value string, seq long, tombstone boolean")
    now = resolve.newest(log_.unionByName(plain, allowMissingColumns=True))
    assert {r.key: r.ttl_ms for r in ttl.ttl(resolve.live(now), wanted, 60).collect()}["x"] == -1
    assert [(r.key, r.seq) for r in ttl.evictions(resolve.live(resolve.newest(log_)), 60).collect()] == [("x", 2)]


def test_lake_life(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    assert lake.size() == 0 and lake.get("a") is None and lake.log().count() == 0
    lake.mput({"a": "1", "b": "2", "é": ""})
    lake.put("a", "3")
    lake.delete("b")
    lake.put("t", "x", ttl_ms=100, now_ms=1000)
    assert as_dict(lake.view()) == {"a": "3", "é": "", "t": "x"} and lake.view(as_of=1100).count() == 2
    assert lake.get("a") == "3" and lake.get("b") is None and lake.exists("é") and not lake.exists("t", as_of=1100)
    assert lake.mget(["b", "a", "b"]) == {"b": None, "a": "3"} and lake.mexists(["a", "é"]) and not lake.mexists(["a", "b"]) and lake.mexists([])
    assert keys_of(lake.scan_prefix("")) == ["a", "t", "é"] and keys_of(lake.scan_range("b", "u")) == ["t"]
    assert lake.ttl(["a", "t", "b"], 1050) == {"a": -1, "t": 50, "b": -2}
    before = as_dict(lake.view())
    names = lake.manifest()["runs"]
    lake.compact(major=False, names=names[1:3])
    assert as_dict(lake.view()) == before and len(lake.manifest()["runs"]) == 3 and lake.log().where("tombstone").count() == 1
    with pytest.raises(ValueError):
        lake.compact(names=lake.manifest()["runs"][:1])
    lake.compact()
    assert as_dict(lake.view()) == before and len(lake.manifest()["runs"]) == 1 and lake.log().where("tombstone").count() == 0
    assert len(lake.vacuum()) == 5 and as_dict(lake.view()) == before
    assert lake.evict(1100) == 1 and lake.evict(1100) == 0 and sorted(keys_of(lake.keys())) == ["a", "é"]
    facts = lake.snapshot(str(tmp_path / "snap"))
    assert facts["rows"] == 2 and as_dict(lake_module.read_snapshot(spark, str(tmp_path / "snap"))) == {"a": "3", "é": ""}
    again = Lake(spark, str(tmp_path / "lake"))
    seq = again.manifest()["next_seq"]
    again.clear()
    assert again.size() == 0 and again.manifest()["next_seq"] == seq
    again.put("a", "new")
    assert again.get("a") == "new" and not again.should_flush()


def test_lake_has_one_writer_per_manifest(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    old = lake.manifest()
    lake.put("a", "1")
    with pytest.raises(Conflict):
        lake._commit(old, ["run-x"], 9)
    assert lake.get("a") == "1"
    with pytest.raises(ValueError):
        lake_module.read_snapshot(spark, str(tmp_path / "none"))


def test_point_reads_reach_the_files(spark, tmp_path, capsys):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.mput({f"k{i:03d}": "v" for i in range(100)})
    lake._narrowed(F.col("key") == "k050", None).explain()
    assert "EqualTo(key,k050)" in capsys.readouterr().out
    lake.scan_prefix("k05").explain()
    assert "StringStartsWith(key,k05)" in capsys.readouterr().out
