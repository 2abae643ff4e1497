"""Command streams as relations (D1 to D6): each read sees the last write before it.

A stream of requests is (pos, ...); its keyed accesses are exploded, the state before each is the last of the key's earlier writes, found span
by span, and answers are gathered by request. Nothing is replayed in a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codecs
from tidemark.operators.order import with_last_before


def dispatch(requests: DataFrame) -> DataFrame:
    """(pos, status, payload) of requests (pos, op, key, value): PUT, GET, DELETE, EXISTS, in order of pos, on an empty store."""
    write = F.when(F.col("op") == "PUT", F.struct(F.col("value").alias("v"))).when(F.col("op") == "DELETE", F.struct(F.lit(None).cast("string").alias("v")))
    held = with_last_before(requests, "key", "pos", write, "_h").withColumn("_held", F.col("_h.v"))
    status = F.when((F.col("op") == "GET") & F.col("_held").isNull(), "NOT_FOUND").otherwise("OK")
    payload = F.when(F.col("op") == "GET", F.col("_held")).when(F.col("op") == "EXISTS", F.when(F.col("_held").isNull(), "0").otherwise("1"))
    return held.select("pos", status.alias("status"), payload.alias("payload"))


def run_commands(commands: DataFrame) -> DataFrame:
    """(pos, reply) of commands (pos, words array, perhaps error), in order of pos, on an empty store; replies in RESP2.

    PING, GET, SET, DEL, EXISTS, MGET, MSET and the stub COMMAND, in either case.
    """
    if "error" not in commands.columns:
        commands = commands.withColumn("error", F.lit(None).cast("string"))
    verb, n = F.upper(F.element_at("words", 1)), F.size("words")
    wrong = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("words").isNull() | (n < 1), F.lit("empty command"))
        .when(verb.isin("GET", "DEL", "EXISTS", "MGET") & (n < 2), F.concat(verb, F.lit(" requires key")))
        .when((verb == "SET") & (n < 3), F.lit("SET requires key value"))
        .when((verb == "MSET") & ((n < 3) | (n % 2 == 0)), F.lit("MSET requires key-value pairs"))
        .when(~verb.isin("PING", "GET", "SET", "DEL", "EXISTS", "MGET", "MSET", "COMMAND"), F.concat(F.lit("unknown command '"), verb, F.lit("'")))
    )
    judged = commands.select("pos", "words", wrong.alias("wrong"), F.when(wrong.isNull(), verb).alias("verb"))
    # One access for each key a command names: its place, and for a write what it leaves (null: nothing).
    step = F.when(F.col("verb") == "MSET", 2).otherwise(1)
    last = F.when(F.col("verb").isin("GET", "SET"), 2).otherwise(F.size("words"))
    places = F.when(F.col("verb").isin("GET", "SET", "DEL", "EXISTS", "MGET", "MSET"), F.sequence(F.lit(2), last, step))
    accesses = judged.select("pos", "verb", "words", F.explode(places).alias("i"))
    put = F.when(F.col("verb").isin("SET", "MSET"), F.element_at("words", F.col("i") + 1))
    write = F.when(F.col("verb").isin("SET", "MSET", "DEL"), F.struct(put.alias("v")))
    accesses = accesses.select("pos", "i", F.element_at("words", F.col("i")).alias("key"), write.alias("write"))
    seen = with_last_before(accesses, "key", "pos", F.col("write"), "_h", ("i",)).withColumn("held", F.col("_h.v"))
    gathered = seen.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("i", "held"))).alias("h"))
    values = F.transform("h", lambda x: x["held"])
    present = F.size(F.filter(values, lambda v: v.isNotNull()))
    reply = (
        F.when(F.col("wrong").isNotNull(), codecs.resp_error(F.col("wrong")))
        .when((F.col("verb") == "PING") & (F.size("words") == 1), F.lit("+PONG\r\n"))
        .when(F.col("verb") == "PING", codecs.resp_bulk(F.element_at("words", 2)))
        .when(F.col("verb") == "GET", codecs.resp_bulk(F.element_at(values, 1)))
        .when(F.col("verb").isin("DEL", "EXISTS"), codecs.resp_integer(present))
        .when(F.col("verb") == "MGET", codecs.resp_array(values))
        .otherwise(codecs.resp_ok())
    )
    return judged.join(gathered, "pos", "left").select("pos", reply.alias("reply"))
