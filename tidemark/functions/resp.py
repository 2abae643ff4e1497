"""RESP2 input: bytes to typed values, for DataFrames of command bytes and for single values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class RespError(ValueError):
    pass


@dataclass(frozen=True)
class Value:
    kind: str  # bulk, simple, error, integer, array, null
    value: object = None


@dataclass
class _Cursor:
    data: bytes
    at: int = 0

    def line(self) -> bytes:
        end = self.data.find(b"\r\n", self.at)
        if end < 0:
            raise RespError(f"no line end after {self.at}")
        found, self.at = self.data[self.at : end], end + 2
        return found

    def integer(self) -> int:
        try:
            return int(self.line().decode("ascii"))
        except ValueError as e:
            raise RespError(str(e)) from e

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise RespError("bulk string cut short")
        found, self.at = self.data[self.at : self.at + n], self.at + n + 2
        return found

    def value(self) -> Value:
        kind, self.at = self.data[self.at : self.at + 1], self.at + 1
        if kind == b"+" or kind == b"-":
            return Value("simple" if kind == b"+" else "error", self.line().decode())
        if kind == b":":
            return Value("integer", self.integer())
        if kind == b"$":
            n = self.integer()
            return Value("null") if n < 0 else Value("bulk", self.take(n).decode())
        if kind == b"*":
            n = self.integer()
            return Value("null") if n < 0 else Value("array", tuple(self.value() for _ in range(n)))
        raise RespError(f"unknown type {kind!r}" if kind else "no more input")


def parse(data: bytes) -> Value:
    """The first value of the bytes."""
    if not data:
        raise RespError("no input")
    return _Cursor(data).value()


def _text(v: Value) -> str | None:
    return None if v.kind == "null" else str(v.value)


def _commands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, errors = [], []
        for data in batch["data"].to_pylist():
            try:
                v = parse(data or b"")
                if v.kind != "array" or not v.value:
                    raise RespError("expected array command" if v.kind != "array" else "empty command")
                words.append([_text(x) for x in v.value])
                errors.append(None)
            except (RespError, UnicodeDecodeError) as e:
                words.append(None)
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string())), pa.array(errors, pa.string())], [*batch.schema.names, "words", "error"])


def parse_commands(df: DataFrame) -> DataFrame:
    """df (data binary, others kept) with words, the command and its arguments, or error."""
    added = [T.StructField("words", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]
    return df.mapInArrow(_commands, T.StructType([*df.schema.fields, *added]))
