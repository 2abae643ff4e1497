"""Sorted runs (I6, I7, C6 to C8) in the binary layout, and their reader with all checks.

Header: magic4 version4 count8 created8. Entries by key: seq8 flag1 (1: tombstone) klen4 key vlen4 value. Index: count4, then for
every 16th key its place8 klen4 key. Footer: index place8, count4, crc4 of all before it, magic4. An empty value is not a tombstone.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import sort_key
from tidemark.operators.order import numbered
from tidemark.sources import files

# Fixed values of the format.
MAGIC, VERSION, EVERY = 0x4E4B5654, 1, 16
_HEADER, _ENTRY, _LENGTH, _PLACE, _FOOTER, _CRC_AT = struct.Struct(">iiqq"), struct.Struct(">qbi"), struct.Struct(">i"), struct.Struct(">qi"), struct.Struct(">qiIi"), 12
SCHEMA = "key string, value string, seq long, tombstone boolean"


class CorruptRun(ValueError):
    pass


def _order(key: str) -> bytes:
    return key.encode("utf-16-be", "surrogatepass")


def encode(entries: Iterable[tuple[str, str | None, int, bool]], created_ms: int = 0) -> bytes:
    """entries: (key, value, seq, tombstone), any order, distinct keys."""
    ordered = sorted(entries, key=lambda e: _order(e[0]))
    out, index = bytearray(_HEADER.pack(MAGIC, VERSION, len(ordered), created_ms)), []
    for i, (key, value, seq, tombstone) in enumerate(ordered):
        k, v = key.encode(), (value or "").encode()
        if i % EVERY == 0:
            index.append((len(out), k))
        out += _ENTRY.pack(seq, 1 if tombstone else 0, len(k)) + k + _LENGTH.pack(len(v)) + v
    index_at = len(out)
    out += _LENGTH.pack(len(index)) + b"".join(_PLACE.pack(at, len(k)) + k for at, k in index)
    head = struct.pack(">qi", index_at, len(ordered))
    return bytes(out) + head + struct.pack(">Ii", zlib.crc32(bytes(out) + head), MAGIC)


class Run:
    """An opened run: its footer and checksum are checked, its index is in memory."""

    def __init__(self, data: bytes):
        if len(data) < _HEADER.size + _FOOTER.size:
            raise CorruptRun("too short")
        magic, version, self.count, self.created_ms = _HEADER.unpack_from(data)
        self.end, count, crc, last = _FOOTER.unpack_from(data, len(data) - _FOOTER.size)
        if magic != MAGIC or last != MAGIC or version != VERSION or count != self.count:
            raise CorruptRun("not a run, or of another version")
        if crc != zlib.crc32(data[: len(data) - _FOOTER.size + _CRC_AT]):
            raise CorruptRun("checksum mismatch")
        self.data, self.places, self.keys = data, [], []
        (n,), at = _LENGTH.unpack_from(data, self.end), self.end + _LENGTH.size
        for _ in range(n):
            place, k = _PLACE.unpack_from(data, at)
            at += _PLACE.size + k
            self.places.append(place)
            self.keys.append(_order(data[at - k : at].decode()))

    def entries(self, at: int = _HEADER.size) -> Iterator[tuple[str, str | None, int, bool]]:
        while at < self.end:  # the index is not data
            seq, flag, k = _ENTRY.unpack_from(self.data, at)
            at += _ENTRY.size + k
            key = self.data[at - k : at].decode()
            (v,) = _LENGTH.unpack_from(self.data, at)
            at += _LENGTH.size + v
            yield key, None if flag else self.data[at - v : at].decode(), seq, bool(flag)

    def ends(self) -> Iterator[tuple[str, str]]:
        """The first and the last key, if there are entries: the last follows the last indexed one."""
        if self.places:
            first = next(self.entries())[0]
            *_, last = self.entries(self.places[-1])
            yield first, last[0]

    def get(self, key: str) -> tuple[str, str | None, int, bool] | None:
        """By binary search in the index and a short walk."""
        i = bisect.bisect_right(self.keys, _order(key)) - 1
        if i < 0:
            return None
        for entry in self.entries(self.places[i]):
            if _order(entry[0]) >= _order(key):
                return entry if entry[0] == key else None
        return None


def read(spark: SparkSession, path: str) -> DataFrame:
    """Key, value, seq, tombstone, source of all entries of run files."""
    rows = files.decoded(files.contents(spark, path), lambda data: Run(data).entries(), SCHEMA)
    return rows.select("key", "value", "seq", "tombstone", F.lit(None).cast("long").alias("expire_at"), F.col("path").alias("source"))


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The entries of run files that wanted (key) names: key, value, seq, tombstone.

    The first and last key of each file, like a manifest a row for each, send a key to the runs that may hold it; a task opens a run and finds
    its keys by the run's index.
    """
    opened = files.contents(spark, path)
    ends = files.decoded(opened, lambda data: Run(data).ends(), "first string, last string").collect()
    ranges = sorted((_order(r["first"]), _order(r["last"]), r["path"]) for r in ends)
    lows, reach = [low for low, _, _ in ranges], list(accumulate((high for _, high, _ in ranges), max))

    def holders(key: str) -> list[str]:
        found, at, i = [], _order(key), bisect.bisect_right(lows, _order(key)) - 1
        while i >= 0 and reach[i] >= at:  # no range before reaches the key
            if ranges[i][1] >= at:
                found.append(ranges[i][2])
            i -= 1
        return found

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sent = [(p, k) for k in batch["key"].to_pylist() if k is not None for p in holders(k)]
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in sent], pa.string()), "key": pa.array([k for _, k in sent], pa.string())})

    asked = wanted.select("key").mapInArrow(send, "path string, key string")

    def find(key: tuple, runs: pa.Table, keys: pa.Table) -> pa.Table:
        found = []
        for content in runs["content"].to_pylist():
            run = Run(content)
            found += [e for k in keys["key"].to_pylist() if (e := run.get(k))]
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        kinds = {"key": pa.string(), "value": pa.string(), "seq": pa.int64(), "tombstone": pa.bool_()}
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns, strict=True)})

    return opened.groupBy("path").cogroup(asked.groupBy("path")).applyInArrow(find, SCHEMA)


def write(resolved: DataFrame, folder: str, partitions: int = 1, created_ms: int = 0) -> int:
    """Resolved entries as run files, each a range of keys; returns how many files."""
    return files.write_parts(resolved, ["key", "value", "seq", "tombstone"], lambda rows: encode(rows, created_ms), folder, "run.sst", partitions, sort_key(F.col("key"), "utf16"))


def sparse_index(resolved: DataFrame, every: int = EVERY) -> DataFrame:
    """The index as a relation: (n, key) of every 16th key in order, from the first."""
    return numbered(resolved.select("key"), "key", "n").where(F.col("n") % every == 0).select("n", "key")
