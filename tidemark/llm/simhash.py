"""SimHash near-duplicates: all pairs of distinct fingerprints compared exactly, in tiles.

A fingerprint is made of whole texts: lower-cased (A-Z), words, 4-word shingles. Rows with the same
fingerprint are one node. Nodes are dealt to tiles by population count (and by a hash where a count has more nodes than
a tile holds); a pair of tiles is a cell, and pairs whose counts differ beyond the radius have no cell. A cell compares its
two tiles with exclusive-or and bit counts, block by block, again without blocks whose counts by parts of the word differ too
much, and gives back a star for each group it finds: as many edges as nodes at most, however large a group of copies is.

The work grows with the square of the number of distinct fingerprints (a few hundredths of all pairs are compared, fewer in larger tiles): that
is the method.
Cells bound what a task holds to two tiles at any size.

Defined results: null text is the empty text; a text without words has fingerprint zero, linked like any other. Fewer than four
words are one shingle. Rows whose doc_id is null take part; a class of such rows only has a null id. Any 64-bit doc_id will do.
Repeated rows share a class. Rows with a repeated doc_id and different texts are documents of their own: their classes (told apart by root,
the least fingerprint) stay apart unless their fingerprints are linked, though both may show that doc_id as their least. Extra columns are
kept by keep_one(), whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import chosen_rows, identified, row_number
from tidemark.llm.components import stars
from tidemark.plans.session import cut, ship

RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 262_144  # nodes of a tile, about
_ROWS, _COLS, _PAIRS, _GROUP = 64, 4096, 2_000_000, 24


def bit_majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes. Counts eight bits at once, in bytes."""
    n, counts = len(hashes), np.zeros((8, 8), np.int64)
    for at in range(0, n, 255 * 256):
        part = hashes[at : at + 255 * 256]
        part = np.concatenate([part, np.zeros(-len(part) % 255, np.uint64)]).reshape(-1, 255)
        for bit in range(8):
            sums = ((part >> np.uint64(bit)) & np.uint64(0x0101010101010101)).sum(axis=1, dtype=np.uint64)
            counts[:, bit] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).reshape(64), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # ASCII letters, ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[SHINGLE - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)]
    return bit_majority(np.array(hashes, np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["row_id"], batch["doc_id"], pa.array(fps, pa.int64())], ["row_id", "doc_id", "fp"])


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row_id, doc_id, fp (the fingerprint as a signed long); computed once. row: the column that numbers the rows."""
    ship(docs.sparkSession)
    rows = docs.select(row_number(row).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(rows.mapInArrow(_fingerprints, "row_id long, doc_id long, fp long"))


def local_stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least member of the group of each of n nodes, by the links i-j."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _part_counts(x: np.ndarray, parts: int) -> np.ndarray:
    width = 64 // parts
    return np.stack([np.bitwise_count((x >> np.uint64(width * k)) & np.uint64((1 << width) - 1)) for k in range(parts)], axis=1).astype(np.int16)


def _grouped(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their counts, where each group of equal counts begins, and the groups' counts."""
    key = np.zeros(len(counts), np.uint64)
    for c in counts.T:
        key = key * np.uint64(65) + c.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return order, begins, counts[order[begins]]


def linked(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs within the radius, by blocks of bounded size.

    Both sides are grouped by the bit counts of parts of the word; groups whose counts add up to more than the radius in differences can't
    hold a pair. The parts are as fine as leaves groups worth a block, which only decides how much is skipped.
    """
    if not len(left) or not len(right):
        return
    for parts in (8, 4, 2):
        order, begins, counts = _grouped(_part_counts(left, parts))
        if len(begins) * _GROUP <= len(left):
            break
    r_order, r_begins, r_counts = _grouped(_part_counts(right, parts))
    ends, r_ends, r_sorted = np.append(begins[1:], len(left)), np.append(r_begins[1:], len(right)), right[r_order]
    for g in range(len(begins)):
        near = np.flatnonzero(np.abs(r_counts - counts[g]).sum(axis=1) <= radius)
        if not len(near):
            continue
        runs = list(zip(r_begins[near].tolist(), r_ends[near].tolist(), strict=True))
        a, there, b = order[begins[g] : ends[g]], np.concatenate([r_sorted[s:e] for s, e in runs]), None
        for x in range(0, len(a), _ROWS):
            rows = left[a[x : x + _ROWS], None]
            for y in range(0, len(there), _COLS):
                close = np.bitwise_count(rows ^ there[y : y + _COLS]) <= radius
                hit = np.flatnonzero(close)  # much quicker than nonzero of two dimensions
                if len(hit):
                    b = np.concatenate([r_order[s:e] for s, e in runs]) if b is None else b
                    yield a[x + hit // close.shape[1]], b[y + hit % close.shape[1]]


def _cell(radius: int):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        node, tile = table["node"].to_numpy(), table["tile"].to_numpy()
        n, same = len(fp), key[0].as_py() == key[1].as_py()
        first = np.flatnonzero(tile == key[0].as_py())
        second = first if same else np.flatnonzero(tile == key[1].as_py())
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for a, b in linked(fp[first], fp[second], radius):
            i, j = first[a], second[b]
            if same:
                i, j = i[i < j], j[i < j]
            found.append((i, j))
            held += len(i)
            if held > _PAIRS:  # keep a star for each group, not all its pairs
                label = local_stars(*map(np.concatenate, zip(*found, strict=True)), n)
                i = np.flatnonzero(label != np.arange(n))
                found, held = [(i, label[i])], 0
        label = local_stars(*map(np.concatenate, zip(*found, strict=True)), n) if found else np.arange(n)
        i = np.flatnonzero(label != np.arange(n))
        return pa.table({"a": pa.array(node[i], pa.int64()), "b": pa.array(node[label[i]], pa.int64())})

    return compare


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect the nodes (fp, node; distinct fp) within the radius: per cell, a star for each group."""
    counted = nodes.withColumn("pop", F.bit_count("fp"))
    sizes = {r["pop"]: r["count"] for r in counted.groupBy("pop").count().collect()}  # 65 rows at most
    subs = [-(-sizes.get(p, 0) // tile) for p in range(65)]
    base = np.concatenate([[0], np.cumsum(subs)]).tolist()
    by_pop = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("pop") + 1)
    low, high = [base[max(0, p - radius)] for p in range(65)], [base[min(64, p + radius) + 1] - 1 for p in range(65)]
    tiled = counted.withColumn("tile", by_pop(base[:65]) + F.pmod(F.xxhash64("fp"), by_pop([max(1, s) for s in subs])).cast("int"))
    dealt = tiled.withColumn("other", F.explode(F.sequence(by_pop(low), by_pop(high))))
    dealt = dealt.select(F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "fp", "node")
    ship(nodes.sparkSession)
    return dealt.groupBy("t1", "t2").applyInArrow(_cell(radius), "a long, b long")


def _rooted(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """fp, root (the least fingerprint of the component) and id (the least doc_id of the fingerprint) of the fingerprints of rows."""
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = stars(links(nodes.select("fp", F.col("fp").alias("node")), radius, tile)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "id")


def classes(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """row_id, doc_id, fp, root, component_id for each row of docs (doc_id, text): the class by its least fingerprint and its least doc_id."""
    rows = fingerprints(docs)
    rooted = cut(_rooted(rows, radius, tile))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp").select("row_id", "doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, with all their columns, that have the smallest doc_id of their class (one row if that is repeated)."""
    rows, row = identified(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    prints = fingerprints(rows, row)
    rooted = prints.join(_rooted(prints, radius, TILE).select("fp", "root"), "fp")
    first = rooted.groupBy("root").agg(F.min_by(F.struct("row_id", F.col("doc_id").alias("id")), order).alias("first"))
    return chosen_rows(rows, row, first.select("first.*"), docs.columns)
