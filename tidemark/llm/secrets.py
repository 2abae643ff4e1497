"""Secret scan: fixed patterns, and two character Markov models compared by their log-likelihood ratio.

One model is trained on random strings and one on ordinary identifiers, both from labelled samples; a candidate
(a long run of key characters with a letter) is reported where the ratio favours the random strings; where that of the whole
run doesn't, as in a long path before a secret, its best stretches are, out to the separators around them.
Everything is DataFrame functions: the text is scanned once, and nothing is shuffled but the samples.

Defined results: null text is the empty text and has no spans; rows with null or repeated doc_id are scanned like any other;
extra columns are kept by scan(). Of overlapping matches of two kinds both are given; an added span overlaps no base one. An empty table gives
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.columns import exactly, let, match_spans, unused

# The base patterns, their kinds in order, and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more: a shorter match ends its run, so nothing longer follows in it
HEX = r"[0-9a-f]{24,}"  # likewise
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST = 6

LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
SEPARATORS = "/_=-"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
START = len(ALPHABET)  # the state before the first character
THRESHOLD = 15.0  # nats; random strings have about 1.4 a sign
VARIETY = (8, 12)  # different signs that a random string has at least: a third of its length, within these bounds
SMOOTHING = 0.5

# Words that ordinary identifiers of the default samples are made of.
IDENTIFIER_WORDS = (
    "access account action address alert api app archive array async auth backup batch block bucket buffer build cache call channel check class client "
    "cloud code column commit config container content core count create data date debug default deploy device document domain email enable encode engine "
    "entry error event export factory field file filter format function gateway group handler header history host image import index info input instance "
    "item job key label language length library limit line link list local log main manager map match memory message method metric mode model module name "
    "network node number object option order output package page parent parse password path payment policy port process product profile project query queue "
    "range read record region remote report request result role root route row rule schedule schema search secret section server service session size "
    "source stage state status storage stream string style system table task template test text thread token total type unit update url user value vector "
    "version view web widget window worker write year zone"
).split()


# Parts of syllables, from which other pronounceable words are made.
ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k l m n p pl pr qu r s sc sh sl sm sn sp st str sw t th tr tw v w wh y z".split()
NUCLEI = "a a a ai e e e ea ee er i i i ie io o o o oo ou ow u u".split()
CODAS = "ck d g l ll m n n nd ng nk nt p r r rd rk rm rn rt s ss st t th w x".split()


def default_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled samples (token, is_random), made by rule: digests in several encodings, and identifiers of words, known ones and ones made of syllables."""
    chance = lambda k, m: F.pmod(F.xxhash64("id", *([F.lit(x) if isinstance(x, str) else x for x in k])), F.lit(m)).cast("int")
    pick = lambda values, *k: F.element_at(F.split(F.lit(" ".join(values)), " "), chance(k, len(values)) + 1)
    syllable = lambda *k: F.concat(pick(ONSETS, *k, "o"), pick(NUCLEI, *k, "n"), F.when(chance((*k, "c"), 2) == 0, pick(CODAS, *k, "d")).otherwise(F.lit("")))
    made = lambda i: F.concat(syllable(i, "a"), syllable(i, "b"), F.when(chance((i, "s"), 2) == 0, F.lit("")).otherwise(pick(NUCLEI, i, "e")))
    word = lambda k: F.element_at("words", k)
    number = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("string")
    either = lambda i: F.when(chance((i, "w"), 2) == 0, made(i)).otherwise(pick(IDENTIFIER_WORDS, i))
    ids = spark.range(0, n, 1, 4).select("id", F.transform(F.sequence(F.lit(1), F.lit(30)), either).alias("words"))
    digest = lambda k: F.unhex(F.sha2(F.concat_ws("-", F.col("id").cast("string"), F.lit(k)).cast("binary"), 256))
    b64 = lambda k: F.base64(digest(k))
    random = [
        F.substring(b64("a"), 1, 40),
        F.translate(F.substring(b64("b"), 1, 43), "+/", "-_"),
        F.translate(F.substring(b64("c"), 1, 36), "+/=", ""),
        F.substring(F.translate(F.upper(b64("d")), "+/=", ""), 1, 32),
        F.substring(F.lower(F.translate(b64("e"), "+/=", "")), 1, 32),
    ]
    ordinary = [
        F.concat_ws("_", word(1), word(2), word(3), number(4, 100)),
        F.concat(word(5), F.initcap(word(6)), F.initcap(word(7)), number(8, 1000)),
        F.concat(F.initcap(word(27)), F.initcap(word(28)), F.initcap(word(29)), number(30, 100)),
        F.concat_ws("-", word(9), word(10), F.concat(F.lit("20"), F.lpad(number(11, 40), 2, "0")), F.lpad(number(12, 12), 2, "0"), F.lpad(number(13, 28), 2, "0")),
        F.upper(F.concat_ws("_", word(14), word(15), word(16), number(17, 10))),
        F.concat_ws("/", word(18), word(19), F.concat(word(20), number(21, 10000)), word(22)),
        F.concat(word(23), F.lit("="), word(24), F.lit("-"), word(25), F.lit("="), number(26, 100000)),
    ]
    labelled = F.concat(*[F.array(F.struct(t.alias("token"), F.lit(r).alias("is_random"))) for r, ts in ((True, random), (False, ordinary)) for t in ts])
    return ids.select(F.explode(labelled).alias("s")).select("s.token", "s.is_random")


def _pairs(token: Column) -> Column:
    """Array of transition numbers: previous state times the states, plus the next."""
    n = START + 1
    state = lambda i: F.pmod(F.position(F.substring(token, i, F.lit(1)), F.lit(ALPHABET)) + F.lit(START), F.lit(n))
    return F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.when(i == 1, F.lit(START)).otherwise(state(i - 1)) * n + state(i))


def train(samples: DataFrame) -> list[float]:
    """log P(next | previous, random) - log P(next | previous, ordinary), by transition number.

    The counts are summed before they are shuffled; what comes to the driver has a row for each pair of characters at most.
    """
    n = START + 1
    tokens = samples.where("token is not null and token <> '' and is_random is not null")
    counts = tokens.select("is_random", F.explode(_pairs(F.col("token"))).alias("t")).groupBy("t").agg(F.count_if("is_random").alias("r"), F.count_if(~F.col("is_random")).alias("o"))
    seen = {x.t: (x.r, x.o) for x in counts.collect()}
    out = []
    for a in range(n):
        row = [seen.get(a * n + b, (0, 0)) for b in range(n)]
        totals = [sum(x[k] for x in row) + SMOOTHING * n for k in (0, 1)]
        out += [math.log((r + SMOOTHING) / totals[0]) - math.log((o + SMOOTHING) / totals[1]) for r, o in row]
    return out


def _table(model: list[float]) -> Column:
    return F.expr(f"cast(split('{','.join(f'{x:.6f}' for x in model)}', ',') as array<double>)")


def log_ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a token; positive: like the random strings."""
    return F.aggregate(_pairs(token), F.lit(0.0), lambda acc, t: acc + F.element_at(_table(model), (t + 1).cast("int")))


STRETCH = "array<struct<start:int,end:int,log_ratio:double>>"


def stretches(token: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """Array of (start, end, log_ratio) of the stretches of a token whose ratio is above the threshold, out to the separators around them.

    A stretch ends at its highest ratio, and the next begins where the ratio has fallen to nothing or by the threshold.
    Stretches that meet are one; those shorter than a candidate are left out.
    """
    table = _table(model)

    def closed(acc: Column) -> Column:
        found = F.struct(acc["first"].alias("start"), acc["last"].alias("end"), acc["peak"].alias("log_ratio"))
        return F.when(acc["peak"] > threshold, F.concat(acc["out"], F.array(found))).otherwise(acc["out"])

    def state(s: Column, at: Column, first: Column, last: Column, peak: Column, out: Column) -> Column:
        return F.struct(s.alias("s"), at.alias("at"), first.alias("first"), last.alias("last"), peak.alias("peak"), out.alias("out"))

    def step(acc: Column, t: Column) -> Column:
        def moved(s: Column) -> Column:
            at, higher = acc["at"] + 1, s > acc["peak"]
            fallen = (s <= 0) | (s < acc["peak"] - threshold)
            on = state(s, at, acc["first"], F.when(higher, at).otherwise(acc["last"]), F.greatest(s, acc["peak"]), acc["out"])
            return F.when(fallen, state(F.lit(0.0), at, at, at, F.lit(0.0), closed(acc))).otherwise(on)

        return let(acc["s"] + F.element_at(table, (t + 1).cast("int")), moved)

    def widened(x: Column) -> Column:
        piece = lambda part, i: F.length(F.substring_index(F.translate(part, SEPARATORS, "/" * len(SEPARATORS)), "/", i))
        before, after = F.substring(token, F.lit(1), x["start"]), F.substring(token, x["end"] + 1, F.length(token))
        return F.struct((x["start"] - piece(before, -1)).alias("start"), (x["end"] + piece(after, 1)).alias("end"), x["log_ratio"].alias("log_ratio"))

    def joined_on(acc: Column, x: Column) -> Column:
        before = F.element_at(acc, -1)
        both = F.struct(before["start"].alias("start"), F.greatest(before["end"], x["end"]).alias("end"), F.greatest(before["log_ratio"], x["log_ratio"]).alias("log_ratio"))
        meet = F.when(F.size(acc) > 0, x["start"] <= before["end"]).otherwise(F.lit(False))
        return F.when(meet, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    none = F.array().cast(STRETCH)
    found = F.aggregate(_pairs(token), state(F.lit(0.0), F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), none), step, closed)
    return F.filter(F.aggregate(F.transform(found, widened), none, joined_on), lambda x: x["end"] - x["start"] >= LEAST)


ADDED = ("base", "added")


def scan(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD, added: tuple[str, str] | list[str] = ADDED) -> DataFrame:
    """docs with base (array of kind, start, end) and added (likewise, with the log ratio), each by start, under the names of added, which docs must not have."""
    if unused(docs.columns, *added) != list(added):
        raise ValueError(f"docs has columns of these names already: {added}")
    model = model or train(default_samples(docs.sparkSession))
    text = F.coalesce(F.col("text"), F.lit(""))
    typed = lambda spans, k: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("ord"), s["end"].alias("end")))
    base = F.array_sort(
        F.concat(
            typed(match_spans(text, ASSIGN, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= ASSIGN_LEAST), 0),
            typed(match_spans(text, ACCESS), 1),
            typed(match_spans(text, HEX), 2),
        )
    )
    lettered = lambda h: h.rlike("[A-Za-z]")
    out = docs.withColumn(added[0], base)
    free = F.filter(match_spans(text, CANDIDATE, lettered), lambda c: ~F.exists(exactly(added[0]), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))

    def scored(c: Column) -> Column:
        whole = lambda r: F.array(F.struct(F.lit(0).alias("start"), F.length(c["hit"]).alias("end"), r.alias("log_ratio")))
        parts = let(log_ratio(c["hit"], model), lambda r: F.when(r > threshold, whole(r)).otherwise(stretches(c["hit"], model, threshold)))
        enough = lambda n: F.greatest(F.lit(VARIETY[0]), F.least(F.lit(VARIETY[1]), n / 3))
        varied = F.filter(parts, lambda x: F.size(F.array_distinct(F.split(F.substring(c["hit"], x["start"] + 1, x["end"] - x["start"]), ""))) >= enough(x["end"] - x["start"]))
        return F.transform(varied, lambda x: F.struct((c["start"] + x["start"]).alias("start"), F.lit(3).alias("ord"), (c["start"] + x["end"]).alias("end"), x["log_ratio"].alias("log_ratio")))

    return out.withColumn(added[1], F.flatten(F.transform(free, scored)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(base: Column, added: Column) -> Column:
    return F.array_sort(F.concat(base, F.transform(added, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))))


def of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["ord"] == kind)).cast("long")

