"""A store of sorted Parquet runs under a manifest: appends, merged reads, minor and major compaction, snapshots.

Each write makes a new run folder, sorted by key within files and with a Bloom filter on the key, and then a new manifest, a JSON
file that names the runs in order; the manifest with the highest number is current. It is written under another name and renamed, so a reader
sees the old state or the new one, and a failed write leaves nothing that is read. Files are reached through Hadoop's file systems.
Old runs stay until vacuum(), for readers that still use them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import batch, resolve, scan, ttl

_PREFIX = "manifest-"


class Conflict(RuntimeError):
    """Another writer was first."""


class Lake:
    """A key-value store in a folder. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, folder: str, source: str = "local"):
        self.spark, self.folder, self.source = spark, folder.rstrip("/"), source

    # Files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path(".").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, top = self._fs(), self._path(".")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n[len(_PREFIX) : -5]) for n in names if n.startswith(_PREFIX) and n.endswith(".json"))

    def _read_manifest(self, number: int) -> dict:
        stream = self._fs().open(self._path(f"{_PREFIX}{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """runs (in order of commit), next_seq, number."""
        numbers = self._numbers()
        return self._read_manifest(numbers[-1]) if numbers else {"runs": [], "next_seq": 1, "number": 0}

    def _commit(self, old: dict, runs: list[str], next_seq: int) -> None:
        new = {"runs": runs, "next_seq": next_seq, "number": old["number"] + 1}
        fs, own, final = self._fs(), self._path(f".{uuid.uuid4().hex}"), self._path(f"{_PREFIX}{new['number']:012d}.json")
        stream = fs.create(own, True)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(own, final):
            fs.delete(own, False)
            raise Conflict(f"manifest {new['number']} exists")

    def _write(self, rows: DataFrame, partitions: int | None = None) -> str:
        name = f"run-{uuid.uuid4().hex}"
        ranged = rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")
        ranged.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.folder}/{name}")
        return name

    def _runs(self, names: list[str]) -> DataFrame:
        """The rows of runs; rank 0 is the newest run, which wins a tie."""
        if not names:
            return self.spark.createDataFrame([], resolve.MUTATION).withColumn("_rank", F.lit(0))
        parts = [self.spark.read.parquet(f"{self.folder}/{n}").withColumn("_rank", F.lit(i)) for i, n in enumerate(reversed(names))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # Reads

    def log(self) -> DataFrame:
        """All mutations that are held."""
        return self._runs(self.manifest()["runs"]).drop("_rank")

    def entries(self, as_of: int | None = None) -> DataFrame:
        """The newest live entries; with as_of, those whose deadline has not come."""
        live = resolve.live(resolve.newest(self._runs(self.manifest()["runs"]), rank="_rank").drop("_rank"))
        return live if as_of is None else ttl.visible(live, as_of)

    def view(self, as_of: int | None = None) -> DataFrame:
        return self.entries(as_of).select("key", "value")

    def _narrowed(self, condition, as_of: int | None) -> DataFrame:
        """Entries whose key meets a condition, which is put to the runs' files, before they are merged."""
        rows = self._runs(self.manifest()["runs"]).where(condition)
        live = resolve.live(resolve.newest(rows, rank="_rank").drop("_rank"))
        return (live if as_of is None else ttl.visible(live, as_of)).select("key", "value")

    def get(self, key: str, as_of: int | None = None) -> str | None:
        row = self._narrowed(F.col("key") == key, as_of).first()
        return row.value if row else None

    def exists(self, key: str, as_of: int | None = None) -> bool:
        return bool(self._narrowed(F.col("key") == key, as_of).take(1))

    def mget(self, keys: list[str], as_of: int | None = None) -> dict[str, str | None]:
        found = {r.key: r.value for r in self._narrowed(F.col("key").isin(keys), as_of).collect()}
        return {k: found.get(k) for k in keys}

    def mexists(self, keys: list[str], as_of: int | None = None) -> bool:
        return not keys or all(v is not None for v in self.mget(keys, as_of).values())

    def scan_prefix(self, start: str, as_of: int | None = None, order: str = "utf8") -> DataFrame:
        return scan.prefix(self._narrowed(F.col("key").startswith(start), as_of), start, order)

    def scan_range(self, low: str = "", high: str = "", as_of: int | None = None) -> DataFrame:
        condition = F.lit(True)
        if low:
            condition &= F.col("key") >= low
        if high:
            condition &= F.col("key") < high
        return scan.between(self._narrowed(condition, as_of), low, high)

    def size(self, as_of: int | None = None) -> int:
        return self.view(as_of).count()

    def keys(self, as_of: int | None = None) -> DataFrame:
        return self.view(as_of).select("key")

    def ttl(self, keys: list[str], as_of: int) -> dict[str, int]:
        return {r.key: r.ttl_ms for r in ttl.ttl(self.entries(), scan.keys_frame(self.spark, keys), as_of).collect()}

    def should_flush(self, threshold: int = resolve.FLUSH_BYTES) -> bool:
        return resolve.memtable(self.log(), threshold).first().should_flush

    # Writes

    def append(self, mutations: DataFrame) -> None:
        """Commits mutations that have their seq; they become visible together."""
        old = self.manifest()
        name = self._write(mutations.select(*[F.col(f.name).cast(f.dataType) if f.name in mutations.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in resolve.MUTATION]))
        top = self.spark.read.parquet(f"{self.folder}/{name}").agg(F.max("seq")).first()[0]
        self._commit(old, [*old["runs"], name], max(old["next_seq"], (top or 0) + 1))

    def mput(self, entries: dict[str, str], ttl_ms: int | None = None, now_ms: int | None = None) -> None:
        rows = batch.mput(self.spark, entries, self.manifest()["next_seq"], self.source)
        if ttl_ms is not None:
            if now_ms is None:
                raise ValueError("a time to live needs the time")
            rows = rows.withColumn("expire_at", F.lit(ttl.deadline(now_ms, ttl_ms)).cast("long"))
        self.append(rows)

    def put(self, key: str, value: str, ttl_ms: int | None = None, now_ms: int | None = None) -> None:
        self.mput({key: value}, ttl_ms, now_ms)

    def mdelete(self, keys: list[str]) -> None:
        self.append(batch.mdelete(self.spark, keys, self.manifest()["next_seq"], self.source))

    def delete(self, key: str) -> None:
        self.mdelete([key])

    def clear(self) -> None:
        """A state without runs; sequence numbers go on."""
        old = self.manifest()
        self._commit(old, [], old["next_seq"])

    def evict(self, as_of: int) -> int:
        """T5: tombstones for expired entries; returns how many."""
        gone = ttl.expired(self.entries(), as_of)
        n = gone.count()
        if n:
            self.append(batch.deletes(gone.select("key"), self.manifest()["next_seq"], self.source))
        return n

    # Maintenance

    def compact(self, major: bool = True, partitions: int | None = None, names: list[str] | None = None) -> None:
        """Runs next to each other (all, or the named ones) become one; major, of all runs only, drops tombstones too."""
        old = self.manifest()
        names = names or old["runs"]
        at = old["runs"].index(names[0]) if names else 0
        if old["runs"][at : at + len(names)] != names:
            raise ValueError("only runs that follow each other can be merged")
        if major and names != old["runs"]:
            raise ValueError("tombstones can only go when all runs are merged")
        if not names:
            return
        merged = resolve.newest(self._runs(names), rank="_rank").drop("_rank")
        name = self._write(resolve.live(merged) if major else merged, partitions)
        self._commit(old, [*old["runs"][:at], name, *old["runs"][at + len(names) :]], old["next_seq"])

    def snapshot(self, target: str) -> dict:
        """I8: the live view as sorted Parquet, and a checksum over it in the target's manifest, which is written last."""
        self.view().repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{target}/data")
        facts = checksum(self.spark.read.parquet(f"{target}/data"))
        Lake(self.spark, target)._commit({"number": 0}, [f"data:{facts['rows']}:{facts['crc']}"], self.manifest()["next_seq"])
        return facts

    def vacuum(self) -> list[str]:
        """Deletes runs and manifests that the current manifest does not use; returns the runs."""
        now, fs = self.manifest(), self._fs()
        gone = []
        for s in fs.listStatus(self._path(".")):
            name = s.getPath().getName()
            if name.startswith("run-") and name not in now["runs"]:
                gone.append(name)
                fs.delete(s.getPath(), True)
            elif name.startswith(_PREFIX) and name != f"{_PREFIX}{now['number']:012d}.json":
                fs.delete(s.getPath(), False)
        return gone


def checksum(view: DataFrame) -> dict:
    """Rows and a checksum of a (key, value) relation that does not depend on their order."""
    row = view.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key", "value")).alias("x")).first()
    return {"rows": row.n, "crc": row.x or 0}


def read_snapshot(spark: SparkSession, target: str) -> DataFrame:
    """The (key, value) relation of a snapshot, or an error where it is not what was written."""
    named = Lake(spark, target).manifest()["runs"]
    if not named:
        raise ValueError("no snapshot, or one that was not finished")
    _, rows, crc = named[0].split(":")
    view = spark.read.parquet(f"{target}/data")
    if checksum(view) != {"rows": int(rows), "crc": int(crc)}:
        raise ValueError("the snapshot's checksum is wrong")
    return view
