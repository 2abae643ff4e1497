"""Small column helpers shared by the operators built from DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.session import cut

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores added as no column has (in either case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def exactly(name: str) -> Column:
    """The column of that name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a number for each row that stays the same when docs is read again, in whatever parts.

    For tables in files it is a hash of the file and the place in it (joins should also compare doc_id); any other DataFrame is
    numbered and kept in the shared folder.
    """
    (name,) = unused(docs.columns, "__row")
    if "_metadata" not in (c.lower() for c in docs.columns):
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name)), name
        except AnalysisException:
            pass
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def row_number(row: str | None) -> Column:
    """The column of that name, else a number of the row that holds for one reading."""
    return exactly(row) if row else F.monotonically_increasing_id()


def chosen_rows(docs: DataFrame, row: str, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the identified docs (row: the name of the number) in the rows that chosen (row_id, id) has."""
    own_row, own_id = unused([*docs.columns, "doc_id"], "row_id", "id")
    chosen = chosen.select(F.col("row_id").alias(own_row), F.col("id").alias(own_id))
    same = (exactly(row) == F.col(own_row)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own_id))
    return docs.join(chosen, same, "left_semi").select(*map(exactly, columns))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def match_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, gaps: bool = False) -> Column:
    """Array of (start, end, hit) of the leftmost non-overlapping matches of a pattern that can't match nothing.

    Offsets are code points, end exclusive: a hit starts after the gaps and hits before it. The running sums are
    taken in blocks, so that a text with very many hits costs little more than one pass.
    keep: a predicate of the hit; failing hits still take their place in the text. gaps: also the text before each hit, as gap.
    """
    fields = ("start", "end", "hit", "gap") if gaps else ("start", "end", "hit")
    kind = "array<struct<" + ",".join(f"{f}:{'int' if f in ('start', 'end') else 'string'}" for f in fields) + ">>"

    def walk(pairs: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + F.length(p["gap"])
            values = {"start": start, "end": start + F.length(p["hit"]), "hit": p["hit"], "gap": p["gap"]}
            return F.struct(values["end"].alias("at"), F.concat(acc["out"], F.array(F.struct(*[values[f].alias(f) for f in fields]))).alias("out"))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step)

    def in_blocks(pairs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        blocks = F.transform(starts, lambda b: walk(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, shifted)

    def shifted(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        offsets = F.aggregate(blocks, first, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        move = lambda b, o: F.transform(b["out"], lambda s: F.struct(*[(s[f] + o if f in ("start", "end") else s[f]).alias(f) for f in fields]))
        return F.flatten(F.zip_with(blocks, offsets, move))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    pairs = F.filter(pairs, lambda p: p["hit"].isNotNull())  # the last gap has no hit
    spans = let(pairs, lambda p: F.when(F.size(p) > 0, in_blocks(p)))
    spans = F.coalesce(F.when(text.rlike(pattern), spans), F.array().cast(kind))
    return F.filter(spans, lambda s: keep(s["hit"])) if keep else spans
