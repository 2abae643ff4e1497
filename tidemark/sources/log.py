"""The binary mutation log (I1 to I5, R7, S12): entries seq8 op1 klen4 key vlen4 value crc4, big-endian, one after the other.

Recovery reads the longest valid prefix: it stops at the first entry that is short or whose checksum is wrong. An appended file is
a new file; files are read in parallel, each from its front.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codecs
from tidemark.sources import files

_HEAD, _LENGTH, _CRC = struct.Struct(">qbi"), struct.Struct(">i"), struct.Struct(">I")
SCHEMA = "seq long, op string, key string, value string"
SPAN = 65_536


class CorruptEntry(ValueError):
    pass


def encode(seq: int, op: str, key: str, value: str = "") -> bytes:
    k, v = key.encode(), value.encode()
    body = _HEAD.pack(seq, codecs.LOG_OPS[op], len(k)) + k + _LENGTH.pack(len(v)) + v
    return body + _CRC.pack(zlib.crc32(body))


def decode(data: bytes, at: int = 0) -> tuple[tuple[int, str, str, str], int] | None:
    """The entry at a place and the place after it; None where the file ends before the entry does; an error where the checksum is wrong."""
    try:
        seq, op, n = _HEAD.unpack_from(data, at)
        if n <= 0:
            return None
        key_end = at + _HEAD.size + n
        (m,) = _LENGTH.unpack_from(data, key_end)
        end = key_end + _LENGTH.size + m
        if m < 0 or end + _CRC.size > len(data):
            return None
        (crc,) = _CRC.unpack_from(data, end)
    except struct.error:
        return None
    if crc != zlib.crc32(data[at:end]):
        raise CorruptEntry(f"entry at {at}: checksum mismatch")
    key, value = data[at + _HEAD.size : key_end], data[end - m : end]
    return (seq, "PUT" if op == codecs.LOG_OPS["PUT"] else "DELETE", key.decode(), value.decode()), end + _CRC.size


def replay(data: bytes) -> Iterator[tuple[int, str, str, str]]:
    """The entries of the longest valid prefix."""
    at = 0
    while True:
        try:
            found = decode(data, at)
        except (CorruptEntry, UnicodeDecodeError):
            return
        if found is None:
            return
        entry, at = found
        yield entry


def read(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The mutations of log files: key, value, seq, tombstone, source (the file)."""
    rows = files.decoded(files.contents(spark, path, stream), replay, SCHEMA)
    gone = F.col("op") == "DELETE"
    return rows.select("key", F.when(~gone, F.col("value")).alias("value"), "seq", gone.alias("tombstone"), F.lit(None).cast("long").alias("expire_at"), F.col("path").alias("source"))


def encoded(mutations: DataFrame) -> DataFrame:
    """mutations (key, value, seq, tombstone) as (seq, entry)."""
    op = F.when(F.col("tombstone"), "DELETE").otherwise("PUT")
    value = F.when(F.col("tombstone"), "").otherwise(F.col("value"))
    return mutations.select("seq", codecs.log_entry(F.col("seq"), op, F.col("key"), value).alias("entry"))


def append_spans(mutations: DataFrame, folder: str, name: str, span: int = SPAN) -> int:
    """Writes one batch as files of spans of seq, so that a long batch is many tasks' work; returns the number of files."""
    return files.write_spans(encoded(mutations), ["entry"], lambda rows: b"".join(r[0] for r in rows), folder, name, "seq", span)


def append(mutations: DataFrame, folder: str, name: str, parts: int = 1) -> int:
    """Writes one batch, its entries in order of seq, as one file or as several ranges of seq; returns the number of files."""
    return files.write_parts(encoded(mutations), ["entry"], lambda rows: b"".join(r[0] for r in rows), folder, name, parts, "seq")


def compacted(mutations: DataFrame, upto: int) -> DataFrame:
    """What a log keeps once a snapshot holds everything up to a seq. Sequence numbers go on from there."""
    return mutations.where(F.col("seq") > upto)
