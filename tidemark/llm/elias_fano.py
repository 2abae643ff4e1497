"""Elias-Fano coding of a non-decreasing sequence, with select.

Of each value the low bits are packed as they are, and the rest is written in unary in a bit array: about 2 + log2(range / length)
bits a value. Every SAMPLE-th one's place is kept in 32 bits, from which select goes on by counts of words.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 512
CHUNK = 8192  # values packed at once; a multiple of 8, so that each begins a byte
_HEADER = struct.Struct("<QQBxxxIII")  # length, least value, low bits, bytes of low, high, samples


class EliasFano:
    def __init__(self, n: int, least: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.least, self.low_bits, self.low, self.high, self.samples = n, least, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """values: non-decreasing signed 64-bit numbers."""
        n = len(values)
        least = int(values[0]) if n else 0
        v = values.astype(np.int64).view(np.uint64) - np.uint64(least % 2**64)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        packed = [np.packbits(((v[at : at + CHUNK, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little") for at in range(0, n, CHUNK)]
        low = np.concatenate(packed) if packed else np.zeros(0, np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-((top >> low_bits) + n + 1) // 64) * 64, np.uint8)
        bits[ones] = 1
        return cls(n, least, low_bits, low, np.packbits(bits, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u4"))

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.low_bits)
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def _ones(self, first: int, last: int) -> np.ndarray:
        """Places of the ones from the first-th to the last-th, exclusive, in the high bits."""
        start = int(self.samples[first // SAMPLE]) // 64
        end = int(self.samples[-(-last // SAMPLE)]) // 64 + 1 if -(-last // SAMPLE) < len(self.samples) else len(self.high)
        before = first - first % SAMPLE - int(np.bitwise_count(self.high[start] & np.uint64((1 << int(self.samples[first // SAMPLE]) % 64) - 1)))
        words = self.high[start:end]
        at = np.flatnonzero(np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little")) + start * 64
        return at[first - before : last - before]

    def range(self, first: int, last: int) -> np.ndarray:
        """The values from the first-th to the last-th, exclusive."""
        if last <= first:
            return np.zeros(0, np.int64)
        high = (self._ones(first, last) - np.arange(first, last)).astype(np.uint64)
        return ((high << np.uint64(self.low_bits)) + self._low(first, last) + np.uint64(self.least % 2**64)).view(np.int64)

    def select(self, i: int) -> int:
        return int(self.range(i, i + 1)[0])

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return _HEADER.pack(self.n, self.least % 2**64, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, least, low_bits, *sizes = _HEADER.unpack_from(data)
        at, parts = _HEADER.size, []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        return cls(n, least, low_bits, np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], "<u8"), np.frombuffer(parts[2], "<u4"))
