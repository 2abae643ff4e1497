"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A file is: the magic, the ids of its documents in a row (little-endian, 16 or 32 bits by the vocabulary), the boundaries
(number of ids before each document and at the end) and the document ids as Elias-Fano sequences, and a footer with the places of these. A
document's place is found by select on the boundaries; no table of 64-bit offsets exists.

Files are shards of the doc_id order. They are written by the task that holds a range of doc_id, under a name of its own that it changes
to the final one at the end, and have the same bytes when a lost task is done again. The folder must be one that driver and executors share;
it is opened through pyarrow's file systems, by its URI.

Defined results: null text is the empty text, a document of the end id alone. Null doc_ids come first. Documents with the same
doc_id are in order of a hash of their texts and of their place in the table, so that a doc_id that many share (or none) is spread over
shards. The string of a special token in a text is that token's id, or ordinary text if plain_specials is set. Other columns are ignored. An
empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.columns import identified
from tidemark.llm.elias_fano import EliasFano
from tidemark.llm.tokens import END_ID, Encoder
from tidemark.plans.session import ship, shuffle_partitions

TOKENIZER = "byte_bpe_50k.json"
MAGIC = b"TIDETOK1"
_FOOTER = struct.Struct("<QQQQQQB7x8s")  # documents, null doc_ids, ids, place of the boundaries, of the doc_ids, of the footer, bytes an id, magic
READ_IDS = 4_000_000


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Writer:
    """Writes one file; ids go out as they come, and only lengths and doc_ids are held."""

    def __init__(self, uri: str, name: str, width: int, attempt: int = 0):
        self.fs, folder = _open(uri)
        self.final, self.own = f"{folder}/{name}", f"{folder}/.{name}.{attempt}"
        self.out = self.fs.open_output_stream(self.own)
        self.out.write(MAGIC)
        self.width, self.lengths, self.doc_ids, self.nulls = width, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.lengths.append(len(ids) // self.width)
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)

    def close(self) -> int:
        """The number of ids."""
        bounds = np.concatenate([[0], np.cumsum(np.array(self.lengths, np.int64))])
        n = int(bounds[-1])
        first = len(MAGIC) + n * self.width
        coded = [EliasFano.build(x).to_bytes() for x in (bounds, np.array(self.doc_ids, np.int64))]
        second, end = first + len(coded[0]), first + len(coded[0]) + len(coded[1])
        self.out.write(b"".join(coded) + _FOOTER.pack(len(self.lengths), self.nulls, n, first, second, end, self.width, MAGIC))
        self.out.close()
        self.fs.move(self.own, self.final)
        return n


class Reader:
    def __init__(self, uri: str, name: str):
        fs, folder = _open(uri)
        self.file = fs.open_input_file(f"{folder}/{name}")
        size = self.file.size()
        self.n, self.nulls, self.ids, first, second, end, self.width, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or end + _FOOTER.size != size or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a token file, or a torn one: {name}")
        self.bounds = EliasFano.from_bytes(self.file.read_at(second - first, first))
        self.doc_ids = EliasFano.from_bytes(self.file.read_at(end - second, second))

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        a, b = self.bounds.range(i, i + 2).tolist()
        return np.frombuffer(self.file.read_at((b - a) * self.width, len(MAGIC) + a * self.width), f"<u{self.width}")

    def documents(self, most: int = READ_IDS) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """doc_ids, boundaries and ids of runs of documents with about so many ids (a document at least)."""
        at = 0
        while at < self.n:
            bounds = self.bounds.range(at, min(self.n, at + 8192) + 1)
            k = max(1, int(np.searchsorted(bounds, bounds[0] + most, "right")) - 1)
            k = min(k, len(bounds) - 1)
            a, b = int(bounds[0]), int(bounds[k])
            ids = np.frombuffer(self.file.read_at((b - a) * self.width, len(MAGIC) + a * self.width), f"<u{self.width}")
            nulls = max(0, min(self.nulls, at + k) - at)
            known = self.doc_ids.range(max(0, at - self.nulls), max(0, at + k - self.nulls)).tolist()
            yield [None] * nulls + known, bounds[: k + 1], ids
            at += k


def _name(shard: int) -> str:
    return f"shard-{shard:06d}.tok"


def _write(uri: str, tokenizer: str, plain_specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encoder, writer, n = TaskContext.get(), Encoder.of(tokenizer, plain_specials), None, 0
        shard, width = task.partitionId(), encoder.dtype.itemsize
        end = np.array([END_ID], encoder.dtype).tobytes()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                writer = writer or Writer(uri, _name(shard), width, task.taskAttemptId())
                writer.add(doc_id.as_py(), encoder.ids(text.as_py()) + end)
                n += 1
        if writer:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n], "n_ids": [writer.close()]})

    return run


def write(docs: DataFrame, uri: str, tokenizer: str = TOKENIZER, shards: int | None = None, plain_specials: bool = False) -> list[tuple[int, int, int]]:
    """Writes docs (doc_id, text) in doc_id order; returns (shard, documents, ids) by shard, a row for each file."""
    spark = docs.sparkSession
    ship(spark)
    fs, folder = _open(uri)
    fs.create_dir(folder, recursive=True)
    placed, row = identified(docs)
    rows = placed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text", row).alias("place"))
    order = ["doc_id", "place"]
    dealt = rows.repartitionByRange(shards or shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    made = dealt.mapInArrow(_write(uri, tokenizer, plain_specials), "shard long, n_docs long, n_ids long").collect()
    return sorted((r.shard, r.n_docs, r.n_ids) for r in made)


def read(spark: SparkSession, uri: str, manifest: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit numbers), from the files."""
    ship(spark)
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in manifest])]).tolist()
    shards = [m[0] for m in manifest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch["id"].to_pylist():
                for doc_ids, bounds, ids in Reader(uri, _name(shards[i])).documents():
                    at = (bounds - bounds[0]).tolist()
                    wide = ids.astype("<u4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids, pa.int64()),
                            pa.array(bounds[:-1] + starts[i]),
                            pa.array(np.diff(bounds)),
                            pa.array([wide[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
