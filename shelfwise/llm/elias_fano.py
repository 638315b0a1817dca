"""Elias-Fano coding of non-decreasing integers with select, over numpy arrays.

A value is split into ``low`` bits, stored as they are, and the rest, stored as ones in a bit string: value ``i``
sets bit ``(value >> low) + i``. That takes about ``2 + log2(range / n)`` bits a value. Selecting value ``i`` finds the
``i``-th one: a directory holds the number of ones before every 512 bits (32-bit counts, 6 % of the bit string),
the rest is counted inside the block.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK_BYTES = 64
MAX_LOW = 56
QUERIES_AT_ONCE = 4096

_BITS = np.unpackbits(np.arange(256, dtype="uint8")[:, None], axis=1, bitorder="little")
ONES_IN_BYTE = _BITS.sum(axis=1).astype("int64")
# ONE_AT[b, k]: position of the k-th one of byte b.
ONE_AT = np.argsort(1 - _BITS, axis=1, kind="stable")


def encode(values: np.ndarray) -> bytes:
    """``values``: non-decreasing, in the range of unsigned 63 bits after subtracting the first."""
    v = np.asarray(values, dtype="int64")
    n = len(v)
    if n == 0:
        return struct.pack("<qqqqq", 0, 0, 0, 0, 0)
    base = int(v[0])
    gap = (v.astype("uint64") - np.uint64(base & (2**64 - 1))).astype("uint64")
    low = min(MAX_LOW, max(0, int((int(gap[-1]) + 1) // n).bit_length() - 1))
    high_at = (gap >> np.uint64(low)).astype("int64") + np.arange(n)
    bits = np.zeros((int(high_at[-1]) // (8 * BLOCK_BYTES) + 1) * 8 * BLOCK_BYTES, dtype="uint8")
    bits[high_at] = 1
    high = np.packbits(bits, bitorder="little")
    low_bits = ((gap[:, None] >> np.arange(low, dtype="uint64")) & np.uint64(1)).astype("uint8")
    lows = np.packbits(low_bits.ravel(), bitorder="little").tobytes() + bytes(8)
    return struct.pack("<qqqqq", n, low, base, len(lows), len(high)) + lows + high.tobytes()


class EliasFano:
    def __init__(self, data: bytes):
        self.n, self.low, self.base, lows, highs = struct.unpack_from("<qqqqq", data)
        at = struct.calcsize("<qqqqq")
        self.lows = np.frombuffer(data, "uint8", lows, at)
        self.high = np.frombuffer(data, "uint8", highs, at + lows).reshape(-1, BLOCK_BYTES)
        ones = ONES_IN_BYTE[self.high].sum(axis=1)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("uint32") if len(ones) else np.zeros(0, "uint32")

    def __len__(self) -> int:
        return self.n

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at these positions."""
        index = np.asarray(index, dtype="int64")
        parts = [self._select(index[i : i + QUERIES_AT_ONCE]) for i in range(0, len(index), QUERIES_AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, "int64")

    def _select(self, index: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.before, index, side="right") - 1
        rows = self.high[block]
        rest = index - self.before[block]
        upto = np.cumsum(ONES_IN_BYTE[rows], axis=1)
        byte = np.argmax(upto > rest[:, None], axis=1)
        lines = np.arange(len(index))
        value = rows[lines, byte]
        rest = rest - (upto[lines, byte] - ONES_IN_BYTE[value])
        high = block * 8 * BLOCK_BYTES + byte * 8 + ONE_AT[value, rest] - index
        if not self.low:
            return high + self.base
        first = index * self.low
        window = self.lows[(first >> 3)[:, None] + np.arange(8)].astype("uint64")
        word = (window << (np.arange(8, dtype="uint64") * np.uint64(8))).sum(axis=1, dtype="uint64")
        low = (word >> (first & 7).astype("uint64")) & np.uint64((1 << self.low) - 1)
        return ((high << self.low) | low.astype("int64")) + self.base
