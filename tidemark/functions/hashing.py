"""Hashes: ring tokens and checksums."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_MASK = (1 << 63) - 1


def ring_token(label: Column) -> Column:
    """The first eight bytes of the MD5 digest, big-endian, without the sign."""
    head = F.conv(F.substring(F.md5(label.cast("binary")), 1, 16), 16, -10).cast("long")
    return head.bitwiseAND(F.lit(TOKEN_MASK))


def token_of(label: str) -> int:
    """ring_token for a label that the driver holds."""
    return int.from_bytes(hashlib.md5(label.encode()).digest()[:8], "big") & TOKEN_MASK


def crc_matches(content: Column, expected: Column) -> Column:
    """The content, or an error where its CRC-32 is another."""
    wrong = F.concat(F.lit("checksum mismatch: expected 0x"), F.lpad(F.lower(F.hex(expected)), 8, "0"), F.lit(", got 0x"), F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0"))
    return F.when(F.crc32(content) == expected, content).otherwise(F.raise_error(wrong).cast("binary"))


def region(content: Column, offset: int, length: int) -> Column:
    """A part of some bytes, offset from 0."""
    return F.substring(content, offset + 1, length)
