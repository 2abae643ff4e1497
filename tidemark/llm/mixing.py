"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Each source's documents are permuted and laid on a line of words, which is cut into blocks; a source may be read cap times, an epoch
each. Its target is met by the blocks of whole epochs and by blocks drawn at random from the next one, the last of them cut, so that the
words are exact. A tree splits the block quotas of all sources among the output shards: at each node the left half's places are filled by
a multivariate hypergeometric draw, source by source, so that every shard gets an exact quota of each source and all quotas are used up.
The blocks drawn from a source are permuted and go to the shards by those quotas, without overlap; what no quota asks for isn't taken.
Documents are cut where blocks end, and a shard's pieces are put in random order.

Offsets on the line come from sums by (source, bucket of the permutation), so that a source with a third of all rows is spread over
as many tasks as there are buckets; a bucket that repeated doc_ids make large is parted by rows. The block table has about shards x
blocks_per_shard rows, the tree's rows hold only quotas over zero; its root is a number for each source. A draw of n blocks takes about
the square root of n steps. Levels of targets are found by sums over the sources, not in one task.

Defined results: null text has no words; null is a source of its own, the last; documents without words are never taken.
Rows with null or repeated doc_id are documents of their own, in the order of their rows. Extra columns are kept by mixed_documents(), whatever
their names. An empty table gives an empty result. Everything depends on the rows and the seed only, so reruns agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.columns import WORD, exactly, identified, let, row_number, unused, word_count
from tidemark.operators.order import numbered
from tidemark.plans.session import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 7
BUCKET_ROWS = 1024
SHARDS = 64  # at least
SHARD_WORDS = 1 << 26  # at most, about
BLOCKS_PER_SHARD = 64
BLOCK_WORDS = 4096  # at least, so that few documents of a small table are cut
SPREAD_LEVEL = 8  # of the tree, from which its nodes are dealt to tasks
TAIL = 12  # standard deviations of a draw that are looked at


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source_key, source, source_size) to those, rank and target: share of all words by weight, filled up to the cap.

    Sources under the cap get the same words a unit of weight. The excess of those above is reshared until none is above.
    """
    placed = numbered(sizes.withColumn("place", F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))), "place", "rank").drop("place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    most = (F.lit(cap) * F.col("source_size")).cast("double")
    s = cut(placed.withColumns({"weight": weight, "most": most}))
    level, capped = 0.0, -1
    while True:
        above = F.col("most") / F.col("weight") < level
        r = s.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("most"))).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.sum("source_size").alias("words")).first()
        if r.n == capped or not r.weight:
            break
        capped, level = r.n, (r.words * share - (r.full or 0.0)) / r.weight
    return s.withColumn("target", F.least("most", F.lit(level) * F.col("weight"))).select("source_key", "source", "source_size", "rank", "target")


def _drawn(n: Column, total: Column, left: Column, u: Column) -> Column:
    """How many of n blocks are among the left ones of total, drawn without replacement: the hypergeometric distribution inverted at u.

    Weights are taken relative to the mode's, first from there up and then down; two passes, and no more held than the present weight.
    """
    long = lambda c: c.cast("long")
    lowest, highest = F.greatest(F.lit(0).cast("long"), left + n - total), F.least(n, left)
    share = n.cast("double") / total
    spread = long(F.lit(TAIL) * F.sqrt(left * share * (1 - share) * (total - left) / F.greatest(total - 1, F.lit(1))) + TAIL)
    mode = F.greatest(lowest, F.least(highest, long(F.floor((left + 1).cast("double") * (n + 1) / (total + 2)))))
    ends = F.struct(mode.alias("mode"), F.least(highest, mode + spread).alias("top"), F.greatest(lowest, mode - spread).alias("bottom"))

    def inverted(e: Column) -> Column:
        none = F.array().cast("array<bigint>")
        upward = F.when(e["top"] > e["mode"], F.sequence(e["mode"] + 1, e["top"])).otherwise(none)
        downward = F.when(e["bottom"] < e["mode"], F.sequence(e["mode"] - 1, e["bottom"], F.lit(-1).cast("long"))).otherwise(none)
        up = lambda w, k: w * (n - k + 1) * (left - k + 1) / (k * (total - n - left + k))
        down = lambda w, k: w * (k + 1) * (total - n - left + k + 1) / ((n - k) * (left - k))
        summed = lambda ks, f: F.aggregate(ks, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), lambda a, k: let(f(a["w"], k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"))))["sum"]

        def walk(first: Column, ks: Column, f) -> Column:
            """From (rest, k found or null): the first k at which the weights use up the rest."""
            start = F.struct(F.lit(1.0).alias("w"), first["rest"].alias("rest"), first["k"].alias("k"))
            step = lambda a, k: let(f(a["w"], k), lambda w: F.struct(w.alias("w"), (a["rest"] - w).alias("rest"), F.when(a["k"].isNull() & (a["rest"] < w), k).otherwise(a["k"]).alias("k")))
            return F.aggregate(ks, start, step, lambda a: F.struct(a["rest"].alias("rest"), a["k"].alias("k")))

        def found(rest: Column) -> Column:
            first = F.struct((rest - 1.0).alias("rest"), F.when(rest < 1.0, e["mode"]).alias("k"))
            return let(walk(first, upward, up), lambda x: F.coalesce(x["k"], walk(x, downward, down)["k"], e["mode"]))

        return let(u * (F.lit(1.0) + summed(upward, up) + summed(downward, down)), found)

    return F.when(lowest == highest, lowest).otherwise(let(ends, inverted))


def _split(quotas: Column, shards: Column, node: Column, seed: int) -> Column:
    """What of each source's blocks (rank, n) goes to the left half of a node's shards: array of (rank, n, k)."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q["n"])
    places = lambda t: F.floor(t * F.floor(shards / 2) / shards).cast("long")

    def draw(acc: Column, q: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), node, q["rank"]), 11) * F.lit(2.0**-53)
        after = lambda k: F.struct(
            (acc["left"] - k).alias("left"), (acc["total"] - q["n"]).alias("total"), F.concat(acc["out"], F.array(F.struct(q["rank"].alias("rank"), q["n"].alias("n"), k.alias("k")))).alias("out")
        )
        return let(_drawn(q["n"], acc["total"], acc["left"], u), after)

    none = F.array().cast("array<struct<rank:bigint,n:bigint,k:bigint>>")
    return let(total, lambda t: F.aggregate(quotas, F.struct(places(t).alias("left"), t.alias("total"), none.alias("out")), draw)["out"])


def splitting_tree(sources: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(rank, blocks) of the sources to (shard, rank, n): the exact quota of blocks, over zero, that each shard gets of each source."""
    quota = F.struct(F.col("rank").cast("long").alias("rank"), F.col("blocks").cast("long").alias("n"))
    root = sources.where("blocks > 0").agg(F.array_sort(F.collect_list(quota)).alias("quotas")).where("size(quotas) > 0")
    tree = root.select(F.lit(0).alias("first"), F.lit(shards).alias("shards"), "quotas")
    half = F.floor(F.col("shards") / 2).cast("int")
    node = F.col("first") * 100_003 + F.col("shards")
    side = lambda out, n: F.filter(F.transform(out, lambda x: F.struct(x["rank"].alias("rank"), n(x).alias("n"))), lambda x: x["n"] > 0)
    child = lambda first, n, q: F.struct(first.cast("int").alias("first"), n.cast("int").alias("shards"), q.alias("quotas"))
    both = let(
        _split(F.col("quotas"), F.col("shards"), node, seed),
        lambda out: F.array(child(F.col("first"), half, side(out, lambda x: x["k"])), child(F.col("first") + half, F.col("shards") - half, side(out, lambda x: x["n"] - x["k"]))),
    )
    whole = F.array(child(F.col("first"), F.col("shards"), F.col("quotas")))
    children = F.explode(F.when(F.col("shards") > 1, both).otherwise(whole)).alias("c")  # the same at each level
    for level in range(max(0, math.ceil(math.log2(shards)))):
        tree = tree.repartition("first") if level == SPREAD_LEVEL else tree
        tree = tree.select(children).select("c.*").where("size(quotas) > 0")
    return tree.select(F.col("first").alias("shard"), F.explode("quotas").alias("x")).select("shard", "x.rank", "x.n")


def _by_hash(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("#", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))).cast("binary"))


def drawn_blocks(sources: DataFrame, width: int, seed: int = SEED) -> DataFrame:
    """(source_key, rank, source_size, quota) to (source_key, rank, epoch, block, words): the blocks that meet the quota.

    All blocks of as many epochs as it holds, and of the next one as many as the rest needs, at random; words: that the block gives, from its first
    on. The line's last block, which may be shorter, is drawn last.
    """
    s = sources.where("quota > 0").withColumn("per_epoch", F.ceil(F.col("source_size") / width))
    s = s.withColumn("full", F.floor(F.col("quota") / F.col("source_size"))).withColumn("rest", F.col("quota") - F.col("full") * F.col("source_size"))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)
    s = s.withColumn("epoch", F.explode(numbers(F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0)))).withColumn("block", F.explode(numbers(F.col("per_epoch"))))
    nth = F.row_number().over(W.partitionBy("source_key", "epoch").orderBy(F.col("block") == F.col("per_epoch") - 1, _by_hash(seed, "source_key", "epoch", "block"), "block")) - 1
    wide = F.least(F.lit(width), F.col("source_size") - F.col("block") * width)
    words = F.when(F.col("epoch") < F.col("full"), wide).otherwise(F.least(wide, F.col("rest") - F.col("nth") * width))
    return s.withColumn("nth", nth).withColumn("words", words.cast("long")).where("words > 0").select("source_key", "rank", "epoch", "block", "words")


def block_table(blocks: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """The drawn blocks (source_key, rank, epoch, block, words) with shard: permuted by source, and dealt by the tree's quotas."""
    quotas = splitting_tree(blocks.groupBy("rank").agg(F.count("*").alias("blocks")), shards, seed)
    until = F.sum("n").over(W.partitionBy("rank").orderBy("shard"))
    slots = quotas.withColumn("until", until).select("rank", "shard", F.explode(F.sequence(F.col("until") - F.col("n"), F.col("until") - 1)).alias("slot"))
    slot = F.row_number().over(W.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), "rank", "epoch", "block"), "epoch", "block")) - 1
    return blocks.withColumn("slot", slot.cast("long")).join(slots, ["rank", "slot"]).select("source_key", "epoch", "block", "words", "shard")


@dataclass
class Mix:
    """rows: row_id, doc_id, source_key, size, source_size, target, at (on the source's line). blocks: see block_table."""

    rows: DataFrame
    blocks: DataFrame
    width: int
    cap: int
    seed: int

    def _candidates(self) -> DataFrame:
        """A row for each block that a document's words lie in, in each epoch."""
        last = F.floor((F.col("at") + F.col("size") - 1) / self.width)
        blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / self.width), last))
        epochs = F.array(*[F.lit(e).cast("long") for e in range(self.cap)])
        return self.rows.withColumn("block", F.explode_outer(blocks)).withColumn("epoch", F.explode(epochs))

    def _begin_and_end(self) -> tuple[Column, Column]:
        first = F.col("block") * self.width
        return F.greatest(first - F.col("at"), F.lit(0)), F.least(first + F.col("words") - F.col("at"), F.col("size"))

    def pieces(self) -> DataFrame:
        """row_id, doc_id, size, epoch, begin, end (words of the document, end exclusive), shard, order_key (order within the shard)."""
        begin, end = self._begin_and_end()
        found = self._candidates().where("size > 0").join(self.blocks, ["source_key", "epoch", "block"]).withColumns({"begin": begin, "end": end}).where("begin < end")
        order = F.xxhash64(F.lit(self.seed), "doc_id", "epoch", "row_id", "begin")
        return found.select("row_id", "doc_id", "size", "epoch", "begin", "end", "shard", order.alias("order_key"))

    def taken(self) -> DataFrame:
        """row_id, doc_id, size, source_size, target, taken for every document: the words of it that the shards get, repeats counted."""
        begin, end = self._begin_and_end()
        found = self._candidates().join(self.blocks, ["source_key", "epoch", "block"], "left")
        drawn = F.when(F.col("words").isNotNull(), F.greatest(end - begin, F.lit(0)))
        words = F.coalesce(F.sum(drawn), F.lit(0)).cast("long")
        return found.groupBy("row_id", "doc_id", "size", "source_size", "target").agg(words.alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, shards: int | None = None, blocks_per_shard: int = BLOCKS_PER_SHARD, block_words: int = BLOCK_WORDS, seed: int = SEED, row: str | None = None) -> Mix:
    """The mix of docs (doc_id, text, source). row: the column that numbers the rows.

    shards: by default one for each SHARD_WORDS words of the mix, SHARDS at least.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"#{seed}")).cast("binary"))
    rows = cut(
        docs.select(
            row_number(row).alias("row_id"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_key"),
            word_count(F.col("text")).alias("size"),
            key.alias("key"),
        )
    )
    bits = min(32, max(0, math.ceil(math.log2(max(1, rows.count()) / BUCKET_ROWS))))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
    summed = lambda r, *more: cut(r.groupBy("source_key", "source", "bucket", *more).agg(F.sum("size").alias("total"), F.count("*").alias("n")))
    buckets = summed(rows)
    large = buckets.where(F.col("n") > 4 * BUCKET_ROWS).select("source_key", "bucket", F.ceil(F.col("n") / BUCKET_ROWS).alias("parts"))
    if large.isEmpty():
        rows, buckets = rows.withColumn("part", F.lit(0).cast("long")), buckets.withColumn("part", F.lit(0).cast("long"))
    else:  # many rows of few doc_ids
        parted = rows.join(large, ["source_key", "bucket"], "left")
        rows = parted.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("parts")), F.lit(0))).drop("parts")
        buckets = summed(rows, "part")
    sources = targets(buckets.groupBy("source_key", "source").agg(F.sum("total").alias("source_size")), weights, share, cap)
    sources = cut(sources.withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.lit(cap) * F.col("source_size"))))
    all_words = sources.agg(F.sum("quota")).first()[0] or 0
    shards = shards or max(SHARDS, -(-all_words // SHARD_WORDS))
    width = max(block_words, -(-all_words // (shards * blocks_per_shard)))
    offset = F.sum("total").over(W.partitionBy("source_key").orderBy("bucket", "part")) - F.col("total")
    before = buckets.withColumn("before", offset).join(sources.drop("source"), "source_key").select("source_key", "bucket", "part", "before", "source_size", "target")
    running = F.sum("size").over(W.partitionBy("source_key", "bucket", "part").orderBy("key", "doc_id", "row_id").rowsBetween(W.unboundedPreceding, 0))
    lined = rows.withColumn("at", running - F.col("size")).join(before, ["source_key", "bucket", "part"]).withColumn("at", F.col("at") + F.col("before"))
    blocks = cut(block_table(drawn_blocks(sources, width, seed), shards, seed))
    return Mix(lined.select("row_id", "doc_id", "source_key", "size", "source_size", "target", "at"), blocks, width, cap, seed)


def words_between(text: Column, begin: Column, end: Column) -> Column:
    """The text from its begin-th word (from its start, for 0) up to the end-th (exclusive), with the space after each word."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    gaps = F.split(text, WORD, -1)
    n = (end - begin).cast("int")
    part = F.zip_with(F.slice(words, (begin + 1).cast("int"), n), F.slice(gaps, (begin + 2).cast("int"), n), lambda w, g: F.concat(w, g))
    return F.concat(F.when(begin == 0, F.element_at(gaps, 1)).otherwise(F.lit("")), F.array_join(part, ""))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with all columns of docs: a row for each piece, by shard and in the shard's order.

    A document read twice is there twice; one that lies in several blocks is in as many pieces, which give its text when put together.
    """
    rows, row = identified(docs)
    pieces = mix(rows, row=row, **options).pieces()
    names = unused(rows.columns, "row_id", "id", "size", "begin", "end", "shard", "order")
    pieces = pieces.select(*[F.col(a).alias(b) for a, b in zip(("row_id", "doc_id", "size", "begin", "end", "shard", "order_key"), names, strict=True)])
    row_id, doc_id, size, begin, end, shard, order = map(exactly, names)
    out = rows.join(pieces, (exactly(row) == row_id) & F.col("doc_id").cast("long").eqNullSafe(doc_id))
    whole = (begin == 0) & (end == size)
    text = F.when(whole, F.col("text")).otherwise(words_between(F.col("text"), begin, end))
    dealt = out.select(*[text.alias("text") if c == "text" else exactly(c) for c in docs.columns], shard, order)
    return dealt.repartition(shard).sortWithinPartitions(shard, order).select(*map(exactly, docs.columns))
