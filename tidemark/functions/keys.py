"""Keys: validity, order and size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"^\p{javaWhitespace}*$"


def is_blank(key: Column) -> Column:
    return key.isNull() | key.rlike(BLANK)


def valid_key(key: Column) -> Column:
    """The key, or an error where it is null or blank."""
    return F.when(is_blank(key), F.raise_error(F.lit("a key must not be null or blank")).cast("string")).otherwise(key)


def valid_value(value: Column) -> Column:
    """The value, or an error where it is null. The empty string is a value."""
    return F.when(value.isNull(), F.raise_error(F.lit("a value must not be null")).cast("string")).otherwise(value)


def check_key(key: str) -> str:
    """valid_key for a key that the driver holds."""
    if key is None or not key.strip():
        raise ValueError("a key must not be null or blank")
    return key


def sort_key(key: Column, order: str = "utf8") -> Column:
    """What to sort by: UTF-8 bytes (Spark's own order, which files prune by) or UTF-16 code units."""
    if order not in ("utf8", "utf16"):
        raise ValueError(order)
    return key if order == "utf8" else F.encode(key, "UTF-16BE")


def entry_bytes(key: Column, value: Column) -> Column:
    """UTF-8 bytes of an entry; a tombstone has those of its key."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")
