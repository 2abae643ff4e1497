from pyspark.sql import functions as F

from tidemark.operators import membership, resolve
from tidemark.sources.lake import Lake
from tidemark.streaming import views

SCHEMA = "key string, value string, seq long, tombstone boolean, expire_at long, at timestamp"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(folder)


def rows(keys, first):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    return [(k, v, first + i, v is None, None, at + datetime.timedelta(seconds=first + i)) for i, (k, v) in enumerate(keys)]


def test_latest_view_goes_on_after_a_restart(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    add(spark, folder, rows([("a", "1"), ("b", "2"), ("c", "3")], 1))
    stream = spark.readStream.schema(SCHEMA).json(folder)
    lake = Lake(spark, str(tmp_path / "lake"))
    for more in (None, [("a", "9"), ("b", None)], [("d", "4")]):
        if more:
            add(spark, folder, rows(more, 10 * len(more)))
        views.into_lake(stream.drop("at"), lake, checkpoint).start().awaitTermination(120)
        batch = resolve.view(spark.read.schema(SCHEMA).json(folder).drop("at"))
        assert sorted(map(tuple, lake.view().collect())) == sorted(map(tuple, batch.collect()))
    views.to_memory(views.latest(stream), "latest", str(tmp_path / "cp2")).start().awaitTermination(120)
    live = {r.key: r.value for r in spark.table("latest").where("not tombstone").collect()}
    assert live == {"a": "9", "c": "3", "d": "4"}
    assert len(lake.manifest()["runs"]) == 3


def test_late_rows_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "log")
    add(spark, folder, rows([("a", "new")], 50))
    add(spark, folder, rows([("a", "late")], 1))
    views.to_memory(views.latest(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)), "late", str(tmp_path / "cp")).start().awaitTermination(120)
    assert [(r.value, r.seq) for r in spark.table("late").collect()] == [("new", 50)]


def test_heartbeats(spark, tmp_path):
    beats = spark.createDataFrame([("a", 900), ("b", 750), ("c", 100), ("a", 100)], "node_id string, ts long")
    beats.write.json(str(tmp_path / "beats"))
    stream = spark.readStream.schema("node_id string, ts long").json(str(tmp_path / "beats"))
    views.to_memory(views.heartbeat_status(stream, 1000, 100, 300), "beats", str(tmp_path / "cp")).start().awaitTermination(120)
    batch = membership.detect(beats.select("node_id").distinct(), beats, 1000, 100, 300)
    assert sorted(map(tuple, spark.table("beats").collect())) == sorted(map(tuple, batch.collect()))


def test_hint_delivery(spark, tmp_path):
    hints = spark.createDataFrame([("n1", "PUT", "k", "v", 5), ("n2", "DELETE", "k", None, 6)], "target string, op string, key string, value string, seq long")
    hints.write.json(str(tmp_path / "h"))
    lakes = {n: Lake(spark, str(tmp_path / n)) for n in ("n1", "n2")}
    members = spark.createDataFrame([("n1", "ACTIVE"), ("n2", "DOWN")], "node_id string, status string")
    views.deliver_hints(spark.readStream.schema(hints.schema).json(str(tmp_path / "h")), members, lakes, str(tmp_path / "cp")).start().awaitTermination(120)
    assert lakes["n1"].get("k") == "v" and lakes["n2"].manifest()["runs"] == []


def test_event_time_windows_and_expiry(spark, tmp_path):
    folder = str(tmp_path / "log")
    add(spark, folder, rows([("a", "1"), ("b", None)], 1) + rows([("c", "x")], 1000))
    stream = spark.readStream.schema(SCHEMA).json(folder)
    query = views.mutation_rates(stream).writeStream.outputMode("append").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.writes, r.deletes) for r in spark.table("rates").collect()] == [(1, 1)]
    beats = stream.select(F.col("key").alias("node_id"), "at")
    views.heartbeat_gaps(beats).writeStream.outputMode("append").format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.node_id for r in spark.table("gaps").collect()) == ["a", "b"]
    spark.createDataFrame([("k", "v", 1, False, 100, None), ("p", "v", 2, False, None, None)], SCHEMA).write.json(str(tmp_path / "t"))
    views.to_memory(views.expiring(spark.readStream.schema(SCHEMA).json(str(tmp_path / "t")), 100), "expiring", str(tmp_path / "cp4")).start().awaitTermination(120)
    assert [r.key for r in spark.table("expiring").collect()] == ["k"]


def test_view_kept_in_a_folder(spark, tmp_path):
    folder, kept = str(tmp_path / "log"), str(tmp_path / "view")
    want = {}
    for n, more in enumerate(([("a", "1"), ("b", "2"), ("c", "3")], [("a", "9"), ("b", None)], [("d", "4"), ("a", "10")])):
        add(spark, folder, rows(more, 10 * n + 1))
        want |= dict(more)
        stream = spark.readStream.schema(SCHEMA).json(folder)
        views.into_folder(views.latest(stream), kept, str(tmp_path / "cp")).start().awaitTermination(120)
        assert {r.key: r.value for r in views.from_folder(spark, kept).collect()} == want
