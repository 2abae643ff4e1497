"""A minimal perfect hash over 32-byte digests, built and probed with numpy.

Levels of bit arrays: at each level a digest hashes to one position; positions hit by exactly one digest are
set, the others' digests go on to the next level. A digest's slot is the rank of its bit. What is left after
the last level gets the slots at the end and is found by its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 40
_A = 0x9E3779B97F4A7C15
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def digest_matrix(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)


def _words(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(matrix).view("<u8")
    return words[:, 1], words[:, 2]


def _position(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    x = a + b * np.uint64(2 * level + 1) + np.uint64(_A * (level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    sizes: np.ndarray  # bits of each level
    bits: np.ndarray  # all levels, one byte a bit
    tail: np.ndarray  # digests that no level placed

    @classmethod
    def build(cls, matrix: np.ndarray) -> PerfectHash:
        a, b = _words(matrix)
        left, sizes, levels = np.arange(len(matrix)), [], []
        while len(left) and len(sizes) < MAX_LEVELS:
            size = max(8, int(GAMMA * len(left)))
            at = _position(a[left], b[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate(levels).astype(np.uint8) if levels else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), bits, matrix[left])

    @property
    def slots(self) -> int:
        return int(self.bits.sum()) + len(self.tail)

    def lookup(self, matrix: np.ndarray) -> np.ndarray:
        """The slot of each digest, or -1. A digest outside the set may get any slot: compare its bytes."""
        a, b = _words(matrix)
        rank = np.cumsum(self.bits, dtype=np.int64) - 1
        slot, open_, offset = np.full(len(matrix), -1, np.int64), np.arange(len(matrix)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _position(a[open_], b[open_], level, size) + offset
            hit = self.bits[at] == 1
            slot[open_[hit]] = rank[at[hit]]
            open_, offset = open_[~hit], offset + size
        if len(self.tail) and len(open_):
            placed, known = int(self.bits.sum()), {x.tobytes(): i for i, x in enumerate(self.tail)}
            for i in open_.tolist():
                slot[i] = placed + known[k] if (k := matrix[i].tobytes()) in known else -1
        return slot

    def to_bytes(self) -> tuple[bytes, bytes, bytes]:
        return self.sizes.tobytes(), np.packbits(self.bits).tobytes(), self.tail.tobytes()

    @classmethod
    def from_bytes(cls, sizes: bytes, bits: bytes, tail: bytes) -> PerfectHash:
        s = np.frombuffer(sizes, np.int64)
        unpacked = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(s.sum()))
        return cls(s, unpacked, np.frombuffer(tail, np.uint8).reshape(-1, 32))
