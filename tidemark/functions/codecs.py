"""Byte formats as column expressions, all big-endian: log entries, wire requests and responses, frames, RESP2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
LOG_OPS = {"PUT": 1, "DELETE": 2}
REQUEST_OPS = {"PUT": 1, "GET": 2, "DELETE": 3, "EXISTS": 4}
STATUSES = {"OK": 0, "NOT_FOUND": 1, "ERROR": 2, "INVALID_REQUEST": 3}
LEAST_FRAME, MOST_FRAME = 1, 64 << 20


def number(value: Column, width: int) -> Column:
    """An integer in so many bytes; negative ones in two's complement."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("long")), F.lit(16), F.lit("0")), F.lit(2 * width)))


def read_number(content: Column, at: Column | int, width: int) -> Column:
    """The unsigned number in width (up to 7) or the signed one in 8 bytes at a place, from 0."""
    return F.conv(F.hex(F.substring(content, _place(at), F.lit(width))), 16, -10).cast("long")


def _place(at: Column | int) -> Column:
    return (F.lit(at) if isinstance(at, int) else at) + 1


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def prefixed(text: Column) -> Column:
    """Four bytes of length, then the UTF-8 bytes; null as empty."""
    content = utf8(F.coalesce(text, F.lit("")))
    return F.concat(number(F.octet_length(content), 4), content)


def _code(name: Column, codes: dict[str, int]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.element_at(known, name), F.raise_error(F.concat(F.lit("unknown code: "), F.coalesce(name, F.lit("null")))).cast("int"))


def _name(code: Column, codes: dict[str, int]) -> Column:
    known = F.create_map(*[F.lit(x) for name, c in codes.items() for x in (c, name)])
    return F.element_at(known, code.cast("int"))


def log_entry(seq: Column, op: Column, key: Column, value: Column) -> Column:
    """seq8 op1 klen4 key vlen4 value crc4, the checksum over all before it."""
    body = F.concat(number(seq, 8), number(_code(op, LOG_OPS), 1), prefixed(key), prefixed(value))
    return F.concat(body, number(F.crc32(body), 4))


def request(op: Column, key: Column, value: Column) -> Column:
    """op1 klen4 key vlen4 value."""
    return F.concat(number(_code(op, REQUEST_OPS), 1), prefixed(key), prefixed(value))


def read_request(content: Column) -> Column:
    """struct(op, key, value, error) of request bytes; error says what is wrong, and then the rest is null."""
    op = _name(read_number(content, 0, 1), REQUEST_OPS)
    key_length = read_number(content, 1, 4)
    value_at = key_length + 5
    value_length = read_number(content, value_at, 4)
    value = F.when(value_length > 0, F.decode(F.substring(content, _place(value_at + 4), value_length), "UTF-8"))
    error = (
        F.when(F.octet_length(content) < 9, F.lit("short request"))
        .when(op.isNull(), F.lit("unknown opcode"))
        .when((key_length <= 0) | (key_length > F.octet_length(content) - 9), F.lit("key length out of range"))
        .when(value_length != F.octet_length(content) - value_at - 4, F.lit("value length out of range"))
        .when((op == "PUT") & value.isNull(), F.lit("PUT needs a value"))
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, op).alias("op"),
        F.when(ok, F.decode(F.substring(content, F.lit(6), key_length), "UTF-8")).alias("key"),
        F.when(ok, value).alias("value"),
        error.alias("error"),
    )


def response(status: Column, payload: Column) -> Column:
    """status1 len4 payload."""
    return F.concat(number(_code(status, STATUSES), 1), prefixed(payload))


def read_response(content: Column) -> Column:
    """struct(status, payload); an empty payload is null."""
    length = read_number(content, 1, 4)
    payload = F.when(length > 0, F.decode(F.substring(content, F.lit(6), length), "UTF-8"))
    return F.struct(_name(read_number(content, 0, 1), STATUSES).alias("status"), payload.alias("payload"))


def frame(content: Column) -> Column:
    """len4 and the content, 1 byte to 64 MB."""
    length = F.octet_length(content)
    wrong = F.raise_error(F.concat(F.lit("frame length out of range: "), length.cast("string"))).cast("binary")
    return F.when(length.between(LEAST_FRAME, MOST_FRAME), F.concat(number(length, 4), content)).otherwise(wrong)


def read_frames(content: Column) -> Column:
    """struct(frames, rest, error) of bytes that hold frames one after the other.

    rest: the bytes of a frame that isn't whole yet. error: says what is wrong with the first length that is out of range, where reading ends.
    """
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,length:bigint>>").alias("places"), F.lit(None).cast("string").alias("error"))
    steps = F.sequence(F.lit(0), F.floor(F.octet_length(content) / (4 + LEAST_FRAME)).cast("int"))  # so many frames there can be

    def step(acc: Column, _: Column) -> Column:
        def judged(n: Column) -> Column:
            whole = acc["error"].isNull() & (n >= LEAST_FRAME) & (n <= MOST_FRAME) & (acc["at"] + 4 + n <= F.octet_length(content))
            wrong = F.when(~n.between(LEAST_FRAME, MOST_FRAME), F.concat(F.lit("frame length out of range: "), n.cast("string")))
            place = F.struct((acc["at"] + 4).alias("at"), n.alias("length"))
            return F.struct(
                F.when(whole, acc["at"] + 4 + n).otherwise(acc["at"]).alias("at"),
                F.when(whole, F.concat(acc["places"], F.array(place))).otherwise(acc["places"]).alias("places"),
                F.coalesce(acc["error"], wrong).alias("error"),
            )

        unsigned = read_number(content, acc["at"], 4)
        signed = F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned)
        more = acc["at"] + 4 <= F.octet_length(content)
        return F.when(more, F.element_at(F.transform(F.array(signed), judged), 1)).otherwise(acc)

    read = F.aggregate(steps, nothing, step)
    pieces = lambda r: F.transform(r["places"], lambda p: F.substring(content, (p["at"] + 1).cast("int"), p["length"].cast("int")))
    made = lambda r: F.struct(pieces(r).alias("frames"), F.substring(content, (r["at"] + 1).cast("int"), F.octet_length(content)).alias("rest"), r["error"].alias("error"))
    return F.element_at(F.transform(F.array(read), made), 1)


def resp_ok() -> Column:
    return F.lit("+OK\r\n")


def resp_error(message: Column) -> Column:
    return F.concat(F.lit("-ERR "), message, F.lit("\r\n"))


def resp_integer(value: Column) -> Column:
    return F.concat(F.lit(":"), value.cast("long").cast("string"), F.lit("\r\n"))


def resp_bulk(value: Column) -> Column:
    """A bulk string, its length in bytes; null as the null bulk (I16)."""
    return F.coalesce(F.concat(F.lit("$"), F.octet_length(value).cast("string"), F.lit("\r\n"), value, F.lit("\r\n")), F.lit("$-1\r\n"))


def resp_array(values: Column) -> Column:
    return F.concat(F.lit("*"), F.size(values).cast("string"), F.lit("\r\n"), F.array_join(F.transform(values, resp_bulk), ""))
