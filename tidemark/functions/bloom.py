"""Bloom filters over string keys: sizing, a 64-bit mix with wrapping arithmetic in numpy, build and probe over DataFrames."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the hash.
SEEDS = (0x9747B28C, 0xC4CEB9FE1A85EC53)
STEP, LAST = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53

GROUP = 64
_U = np.uint64


def sizing(expected: int, rate: float) -> tuple[int, int]:
    """Bits and number of hashes for so many keys at a rate of false positives."""
    if expected <= 0 or not 0 < rate < 1:
        raise ValueError("expected must be positive and rate between 0 and 1")
    bits = math.ceil(-expected * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, math.floor(bits / expected * math.log(2) + 0.5))


def mix(keys: list[bytes], seed: int) -> np.ndarray:
    """The 64-bit mix of each key, byte by byte over all keys at once."""
    lengths = np.array([len(k) for k in keys], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer(b"".join(keys), np.uint8)
    starts = (np.cumsum(lengths) - lengths)[order]
    ordered = lengths[order]
    h = np.full(len(keys), seed, _U)
    for i in range(int(ordered[0]) if len(keys) else 0):
        n = int(np.searchsorted(-ordered, -i, "left"))  # keys longer than i come first
        x = (h[:n] ^ flat[starts[:n] + i].astype(_U)) * _U(STEP)
        h[:n] = x ^ (x >> _U(33))
    h ^= ordered.astype(_U)
    h = (h ^ (h >> _U(33))) * _U(LAST)
    out = np.empty_like(h)
    out[order] = h ^ (h >> _U(33))
    return out


def positions(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """Bit numbers of each key: (h1 + i h2) mod bits in signed arithmetic that wraps, made positive."""
    h1, h2 = mix(keys, SEEDS[0]), mix(keys, SEEDS[1])
    combined = (h1[:, None] + np.arange(hashes, dtype=_U) * h2[:, None]).view(np.int64)
    return np.mod(combined, bits)  # the remainder of the least size, made positive


class Bloom:
    def __init__(self, bits: int, hashes: int, content: np.ndarray | None = None):
        self.bits, self.hashes = bits, hashes
        self.content = np.zeros(-(-bits // 8), np.uint8) if content is None else content

    def add(self, keys: list[bytes]) -> None:
        at = positions(keys, self.bits, self.hashes).reshape(-1)
        np.bitwise_or.at(self.content, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def might_contain(self, keys: list[bytes]) -> np.ndarray:
        at = positions(keys, self.bits, self.hashes)
        return (self.content[at >> 3] >> (at & 7) & 1).all(axis=1)

    def to_bytes(self) -> bytes:
        """m4 k4 len4 bits."""
        return struct.pack(">iii", self.bits, self.hashes, len(self.content)) + self.content.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Bloom:
        bits, hashes, n = struct.unpack_from(">iii", data)
        return cls(bits, hashes, np.frombuffer(data[12 : 12 + n], np.uint8).copy())


def _utf8(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def build(keys: DataFrame, expected: int, rate: float = 0.01) -> DataFrame:
    """One row: bloom, the filter of all keys (key string). Each task makes its own filter; unions are taken bit by bit, of GROUP filters at a time."""
    bits, hashes = sizing(expected, rate)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Bloom(bits, hashes)
        for batch in batches:
            own.add(_utf8(batch["key"]))
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "content": [own.content.tobytes()]})

    def union(key: tuple, table: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(c.as_buffer(), np.uint8) for c in table["content"]])
        return pa.table({"part": pa.array([0], pa.int64()), "content": pa.array([whole.tobytes()], pa.binary())})

    filters = keys.where(F.col("key").isNotNull()).select("key").mapInArrow(partial, "part long, content binary")
    for group in (F.floor(F.col("part") / GROUP), F.lit(0)):
        filters = filters.withColumn("part", group.cast("long")).groupBy("part").applyInArrow(union, "part long, content binary")
    head = struct.pack(">iii", bits, hashes, -(-bits // 8))
    return filters.select(F.concat(F.lit(bytearray(head)), "content").alias("bloom"))


def probe(keys: DataFrame, bloom: bytes) -> DataFrame:
    """keys (key string, others kept) with maybe: false where the key is surely not in the filter."""
    own = Bloom.from_bytes(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.might_contain(_utf8(batch["key"])))], [*batch.schema.names, "maybe"])

    from pyspark.sql import types as T

    return keys.mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField("maybe", T.BooleanType())]))
