"""Chat formatting with a grammar round trip.

A conversation is written as turns, each ``<|im_start|>role\\ntext<|im_end|>\\n``. The written turn is parsed again by the grammar below; where
what comes back is not the source, the conflicting content is escaped and the turn is tried again, until it is identical.

Grammar (deterministic: each rule begins with a control string or runs to the next one):
    conversation = turn*
    turn         = "<|im_start|>" field "\\n" field "<|im_end|>" "\\n"
    field        = text without control strings; in it "<", one or more backslashes and "|" stand for one backslash less
Escaping puts one backslash more into every "<", backslashes, "|". In a role, line ends and "%" are also written as %0A and %25.

Rows are dealt by conversation and sorted by turn; a task goes through them in a stream and holds one turn at a time, so a conversation of any
length needs no more memory than its longest turn.

Defined results: null text and null role are empty. Turns are in order of turn (null first), then role, then text: repeated turns
stay. Rows with null conv_id are one conversation. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.session import ship

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


class GrammarError(ValueError):
    pass


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of a written conversation: role, text, and where the written text begins and ends."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise GrammarError(f"no turn begins at {at}")
        at += len(START)
        line = text.find("\n", at)
        if line < 0 or _PLAIN.search(text, at, line) and any(m[1] == "" for m in _PLAIN.finditer(text, at, line)):
            raise GrammarError(f"no role at {at}")
        begin, end = line + 1, text.find("<|", line + 1)
        if end < 0 or not text.startswith(f"{END}\n", end):
            raise GrammarError(f"text from {begin} does not end at a turn's end")
        yield unescape_role(text[at:line]), unescape(text[begin:end]), begin, end
        at = end + len(END) + 1


def render_turn(role: str, text: str) -> str:
    """The turn as it is, or with what conflicts escaped: the first form that is parsed to its source."""
    for r, t in ((role, text), (role, escape(text)), (escape_role(role), escape(text))):
        written = f"{START}{r}\n{t}{END}\n"
        try:
            if [x[:2] for x in parse(written)] == [(role, text)]:
                return written
        except GrammarError:
            pass
    raise AssertionError("escaping makes every turn parse")


def render(turns: Iterable[tuple[str, str]]) -> str:
    return "".join(render_turn(r, t) for r, t in turns)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, of, offset = 0, object(), 0
    for batch in batches:
        out: dict[str, list] = {"conv_id": [], "segment": [], "offset": [], "written": [], "mask_start": [], "mask_end": []}
        for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != of:
                number, of, offset = 0, conv, 0
            written = render_turn(role or "", text or "")
            ((got, _, begin, end),) = parse(written)
            trained = got == TRAINED
            for c, x in zip(out, (conv, number, offset, written, offset + begin if trained else None, offset + end if trained else None), strict=True):
                out[c].append(x)
            number, offset = number + 1, offset + len(written)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if c == "written" else pa.int64()) for c, v in out.items()], list(out))


def format_chats(conversations: DataFrame) -> DataFrame:
    """The written turns of conversations (conv_id, turn, role, text), each conversation's together and in order.

    conv_id, segment (from 0), offset (code points of the conversation before it), written, mask_start and mask_end (the span of the
    conversation that bears loss, null for other roles). A conversation's output is its segments joined.
    """
    ship(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_segments, "conv_id long, segment long, offset long, written string, mask_start long, mask_end long")


class Digest:
    """What is read back of one conversation, segment by segment."""

    def __init__(self):
        self.turns, self.n, self.loss, self.loss_chars, self.chars = hashlib.sha256(), 0, hashlib.sha256(), 0, 0

    def add(self, written: str, offset: int, mask_start: int | None, mask_end: int | None) -> None:
        assert offset == self.chars, "segments follow each other"
        for role, text, _, _ in parse(written):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        if mask_start is not None:
            masked = unescape(written[mask_start - offset : mask_end - offset])
            self.loss.update(masked.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(masked)
        self.chars += len(written)

    def row(self, conv: int | None) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.string() if "sha" in n else pa.int64() for n in names]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    now, digest, rows = None, None, []
    for batch in batches:
        for conv, segment, *rest in zip(*(batch[c].to_pylist() for c in ("conv_id", "segment", "written", "offset", "mask_start", "mask_end")), strict=True):
            if segment == 0:
                if digest:
                    rows.append(digest.row(now))
                now, digest = conv, Digest()
            digest.add(*rest)
        if len(rows) >= 1000:
            yield made(rows)
            rows = []
    if digest:
        rows.append(digest.row(now))
    if rows:
        yield made(rows)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation of what the grammar reads from format_chats' output, whose order it needs."""
    return formatted.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
