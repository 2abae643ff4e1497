"""Binary snapshots (I8, I9): magic4 version4 count8, then klen4 key vlen4 value for each entry, crc4 of all before it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import files

# Fixed values of the format.
MAGIC, VERSION = 0x4E4B5350, 1
_HEADER, _LENGTH, _CRC = struct.Struct(">iiq"), struct.Struct(">i"), struct.Struct(">I")


class CorruptSnapshot(ValueError):
    pass


def encode(entries: Iterable[tuple[str, str]]) -> bytes:
    rows = list(entries)
    out = bytearray(_HEADER.pack(MAGIC, VERSION, len(rows)))
    for key, value in rows:
        for content in (key.encode(), value.encode()):
            out += _LENGTH.pack(len(content)) + content
    return bytes(out) + _CRC.pack(zlib.crc32(out))


def decode(data: bytes) -> Iterator[tuple[str, str]]:
    if len(data) < _HEADER.size + _CRC.size:
        raise CorruptSnapshot("too short")
    magic, version, n = _HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise CorruptSnapshot("not a snapshot, or of another version")
    if _CRC.unpack_from(data, len(data) - _CRC.size)[0] != zlib.crc32(data[: -_CRC.size]):
        raise CorruptSnapshot("checksum mismatch")
    at = _HEADER.size
    for _ in range(n):
        pair = []
        for _ in range(2):
            (k,) = _LENGTH.unpack_from(data, at)
            at += _LENGTH.size + k
            pair.append(data[at - k : at].decode())
        yield pair[0], pair[1]


def read(spark: SparkSession, path: str) -> DataFrame:
    return files.decoded(files.contents(spark, path), decode, "key string, value string").select("key", "value")


def write(view: DataFrame, folder: str, name: str, parts: int = 1) -> int:
    """A (key, value) view as one file by key, or as several ranges of keys, each a snapshot of its own; returns the number of files."""
    return files.write_parts(view, ["key", "value"], encode, folder, name, parts, "key")
