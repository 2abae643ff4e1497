"""Reading and writing whole files of own formats: read by Spark's binaryFile source, from any store it knows and as batch or stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.session import ship


def contents(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(path, content) of the files at a path or glob, a row each."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile")
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    return reader.load(path).select("path", "content")


def decoded(files: DataFrame, decode: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that decode gives for each file's content, with the file's path first. One file is one task's work: formats are read from the front."""
    ship(files.sparkSession)
    names = ["path", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for row in decode(content.as_py()):
                    rows.append((path.as_py(), *row))
                    if len(rows) == 10_000:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}
    types = [pa.string(), *[kinds[c.split()[1]] for c in schema.split(", ")]]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.mapInArrow(run, f"path string, {schema}")


def write_each(df: DataFrame, folder: str) -> int:
    """Writes df (name string, content binary), a file each, under its own name at the end of the writing; returns how many.

    folder: a URI of a store that driver and executors share.
    """
    ship(df.sparkSession)
    uri = folder if "://" in folder else f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        n = 0
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                own = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(own) as out:
                    out.write(content)
                fs.move(own, f"{base}/{name}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return df.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_spans(df: DataFrame, columns: list[str], encode: Callable[[list[tuple]], bytes], folder: str, name: str, by: str, span: int) -> int:
    """Writes df as files of spans of an integer column, each sorted by it; returns how many. What a span holds is known beforehand, and is one task's work.

    A file is called name with the number of its span before the suffix.
    """
    stem, dot, suffix = name.rpartition(".")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.sort_by(by)[c].to_pylist() for c in columns), strict=True))
        return pa.table({"name": [f"{stem}-{key[0].as_py():012d}{dot}{suffix}"], "content": pa.array([encode(rows)], pa.binary())})

    ship(df.sparkSession)
    dealt = df.select(*dict.fromkeys([by, *columns]), F.floor(F.col(by) / span).alias("_span"))
    return write_each(dealt.groupBy("_span").applyInArrow(run, "name string, content binary"), folder)


def write_parts(df: DataFrame, columns: list[str], encode: Callable[[list[tuple]], bytes], folder: str, name: str, parts: int, by: Column | str) -> int:
    """Writes df as files of ranges of a column, sorted by it; returns how many. A range must fit in one task's memory.

    One part is called name; more have their number before its suffix. Empty parts have no file.
    """
    stem, dot, suffix = name.rpartition(".")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [r for b in batches for r in zip(*(b[c].to_pylist() for c in columns), strict=True)]
        if rows:
            own = name if parts == 1 else f"{stem}-{TaskContext.get().partitionId():05d}{dot}{suffix}"
            yield pa.RecordBatch.from_pydict({"name": [own], "content": [encode(rows)]})

    ship(df.sparkSession)
    dealt = df.repartition(1).sortWithinPartitions(by) if parts == 1 else df.repartitionByRange(parts, by).sortWithinPartitions(by)
    return write_each(dealt.select(*columns).mapInArrow(run, "name string, content binary"), folder)
