"""A store as its users see it: the protocol of stores, and a client that sends commands in bytes and reads the replies.

The client queues commands and runs them as one command stream, so that a thousand commands are one job and not a thousand.
"""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codecs, resp
from tidemark.operators import commands


@runtime_checkable
class Store(Protocol):
    """What a key-value store does; a Lake is one."""

    def put(self, key: str, value: str) -> None: ...

    def get(self, key: str) -> str | None: ...

    def delete(self, key: str) -> None: ...

    def exists(self, key: str) -> bool: ...

    def size(self) -> int: ...

    def keys(self) -> DataFrame: ...

    def clear(self) -> None: ...


class ReplyError(RuntimeError):
    """The server's error reply."""


class Client:
    """Queues commands as RESP2 bytes; flush() runs them in order on an empty store and returns a reply for each."""

    def __init__(self, spark: SparkSession):
        self.spark, self.queue = spark, []

    def send(self, *words: str) -> int:
        """Queues a command; returns its place among those of the next flush."""
        if not words or any(w is None for w in words):
            raise ValueError("a command is one or more words")
        self.queue.append(list(words))
        return len(self.queue) - 1

    def flush(self, strict: bool = False) -> list:
        """Replies in order: str, int, None or a list of them; an error reply as a ReplyError, raised if strict."""
        queue, self.queue = self.queue, []
        if not queue:
            return []
        rows = self.spark.createDataFrame(list(enumerate(queue)), "pos long, words array<string>")
        data = rows.select("pos", codecs.utf8(codecs.resp_array(F.col("words"))).alias("data"))
        replies = commands.run_commands(resp.parse_commands(data)).collect()
        read = [_plain(resp.parse(r.reply.encode())) for r in sorted(replies, key=lambda r: r.pos)]
        if strict and (wrong := next((r for r in read if isinstance(r, ReplyError)), None)):
            raise wrong
        return read


def _plain(v: resp.Value):
    if v.kind == "error":
        return ReplyError(v.value)
    return [_plain(x) for x in v.value] if v.kind == "array" else v.value
