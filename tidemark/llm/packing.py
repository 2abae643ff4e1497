"""Packing documents into sequences: vector bin packing by the dot-product heuristic.

A sequence has limits on tokens, on segments (pieces of documents) and on tokens that bear loss. Into an open sequence goes, of the
pieces that fit, the one whose demands have the largest dot product with what is left of the limits; when none fits, one is cut
to what is left, and its rest goes back. A sequence that ends short of the limit, at the end of the input or for its segments, is
cut into sequences whose lengths are powers of two, which need no padding.

Each task packs what it reads, from a pool bounded in tokens and documents: nothing is shuffled, a lost task packs the same rows again to
the same sequences, and what is held does not grow with the input. Pieces of equal demands are one kind, of which any will do, so that
the work of a step doesn't grow with the number of short documents that wait.

Defined results: null text is the empty text, a document of the end id alone. Null or repeated doc_id are documents of
their own. Of pieces with the same product the kind that came first is taken, and of a kind the piece that came last. The string of a special
token in a text is that token's id, or ordinary text if plain_specials is set. Other columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import END_ID, Encoder
from tidemark.plans.session import ship

LENGTH = 4096
TOKENIZER = "word_bpe_49k.json"
POOL_TOKENS = 1_000_000
POOL_DOCS = 50_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long, segment long"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Limits:
    tokens: int = LENGTH
    segments: int = 12
    loss: int = LENGTH


class Packer:
    """Places documents (doc_id, ids, number of prompt ids, which bear no loss) and yields finished sequences.

    What waits is kept by demands: pieces of as many tokens and loss-bearing tokens are one kind, so that a step costs by the kinds
    that wait, not by the pieces. There are never more than pool_tokens (and one document) or pool_docs of them.
    """

    def __init__(self, limits: Limits, pool_tokens: int = POOL_TOKENS, pool_docs: int = POOL_DOCS):
        assert limits.tokens > 0 and limits.tokens & (limits.tokens - 1) == 0, "a power of two"
        assert limits.segments > 0 and limits.loss > 0
        self.limits, self.pool_tokens, self.pool_docs = limits, pool_tokens, pool_docs
        self.kinds: dict[tuple[int, int], int] = {}  # tokens and loss-bearing tokens: place in the arrays
        self.pieces: list[list[tuple]] = []  # of each kind: (document, start)
        self.demand, self.count = np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
        self.waiting, self.docs, self.new = 0, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray, prompt: int = 0) -> Iterator[list[tuple]]:
        self.new.append((doc_id, ids, prompt))
        self.waiting += len(ids)
        self.docs += 1
        if self.waiting > self.pool_tokens or self.docs > self.pool_docs:
            yield from self._pack(self.pool_tokens // 2, self.pool_docs // 2)

    def finish(self) -> Iterator[list[tuple]]:
        yield from self._pack(0, 0)

    def _take_in(self) -> None:
        """Puts new documents with what waits; kinds that none waits of any more are forgotten."""
        by_kind = {kind: self.pieces[k] for kind, k in self.kinds.items() if self.pieces[k]}
        for doc in self.new:
            n = len(doc[1])
            by_kind.setdefault((n, n - min(doc[2], n)), []).append((doc, 0))
        self.new, self.pieces = [], list(by_kind.values())
        self.kinds = {kind: k for k, kind in enumerate(by_kind)}
        self.demand = np.array(list(by_kind), np.int64).reshape(-1, 2).T.copy()
        self.count = np.array([len(p) for p in self.pieces], np.int64)

    def _put_back(self, kind: tuple[int, int], piece: tuple) -> None:
        k = self.kinds.setdefault(kind, len(self.pieces))
        if k == len(self.pieces):
            self.pieces.append([])
            self.demand, self.count = np.append(self.demand, np.array([kind]).T, axis=1), np.append(self.count, 0)
        self.pieces[k].append(piece)
        self.count[k] += 1
        self.docs += 1

    def _pack(self, until: int, until_docs: int) -> Iterator[list[tuple]]:
        self._take_in()
        lim = self.limits
        while self.waiting > until or self.docs > until_docs:
            tokens, segments, loss, placed = lim.tokens, lim.segments, lim.loss, []
            while tokens and segments and loss and self.waiting:
                left, bearing = self.demand
                # Each demand and what is left of its limit as shares of the limit; a segment is one demand for any piece.
                score = left * (tokens / lim.tokens**2) + bearing * (loss / lim.loss**2) + segments / lim.segments**2
                score[(self.count == 0) | (left > tokens) | (bearing > loss)] = -1.0
                k = int(score.argmax())
                if score[k] < 0:  # none fits: the largest is cut
                    k = int(np.where(self.count > 0, left, -1).argmax())
                n, b = int(left[k]), int(bearing[k])
                doc, at = self.pieces[k].pop()
                self.count[k] -= 1
                self.docs -= 1
                free = n - b
                take = min(n, tokens, free + loss)
                borne = max(0, take - free)
                if take < n:
                    self._put_back((n - take, b - borne), (doc, at + take))
                self.waiting -= take
                placed.append((doc, at, at + take))
                tokens, segments, loss = tokens - take, segments - 1, loss - borne
            yield from self._finished(placed)

    def _finished(self, placed: list[tuple]) -> Iterator[list[tuple]]:
        """The sequence, or as many as its length has powers of two, largest first."""
        total = sum(b - a for _, a, b in placed)
        lengths = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        at = 0
        for length in lengths:
            out = []
            while length:
                doc, a, b = placed[at]
                n = min(length, b - a)
                out.append((doc, a, a + n))
                length -= n
                if a + n == b:
                    at += 1
                else:
                    placed[at] = (doc, a + n, b)
            yield out


def _pack(tokenizer: str, limits: Limits, has_prompt: bool, plain_specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = Encoder.of(tokenizer, plain_specials), Packer(limits)
        end = np.array([END_ID], encoder.dtype).tobytes()
        number, rows, held = TaskContext.get().partitionId() << 32, [], 0

        def sequences() -> Iterator[list[tuple]]:
            for batch in batches:
                prompts = batch["prompt"] if has_prompt else [None] * batch.num_rows
                for doc_id, prompt, text in zip(batch["doc_id"], prompts, batch["text"], strict=True):
                    head = encoder.ids(prompt.as_py()) if has_prompt else b""
                    ids = np.frombuffer(head + encoder.ids(text.as_py()) + end, encoder.dtype)
                    yield from packer.add(doc_id.as_py(), ids, len(head) // encoder.dtype.itemsize)
            yield from packer.finish()

        def flush() -> pa.RecordBatch:
            kinds = [pa.binary() if c == "ids" else pa.int64() for c in _COLUMNS]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], _COLUMNS)

        for placed in sequences():
            offset = 0
            for segment, ((doc_id, ids, prompt), a, b) in enumerate(placed):
                rows.append((doc_id, a, b - a, ids[a:b].astype("<u4").tobytes(), len(ids), b - min(b, max(a, prompt)), number, offset, segment))
                offset += b - a
            number, held = number + 1, held + offset
            if held > 500_000:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, limits: Limits | None = None, plain_specials: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text, and perhaps prompt, put before the text, whose tokens bear no loss).

    ids: the piece's ids as little-endian unsigned 32-bit numbers; doc_tokens: those of its whole document, with the end id.
    """
    ship(docs.sparkSession)
    has_prompt = "prompt" in docs.columns
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    rows = docs.select(*columns, *([F.col("prompt").cast("string").alias("prompt")] if has_prompt else []))
    return rows.mapInArrow(_pack(tokenizer, limits or Limits(), has_prompt, plain_specials), SCHEMA)
