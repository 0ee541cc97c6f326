"""Elias-Fano coding of a non-decreasing sequence, with a select structure.

``n`` values up to ``u`` take about ``2 + log2(u / n)`` bits each: the low bits
as they are, the high bits as a unary bit vector in which value ``i`` is the
``i``-th one, at position ``high + i``. ``get`` finds that one through sampled
positions (one 32-bit number per ``SAMPLE`` values) and popcounts from there.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_SLICE = 1 << 16  # values packed or unpacked at a time (a multiple of 8, so slices end on bytes)
_HEAD = struct.Struct("<QQBxxxxxxx")  # values, bytes of the high part, low bits


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = v.size
        if n and (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros((n * low_bits + 7) // 8, np.uint8)
        places = np.arange(low_bits, dtype=np.uint64)
        for i in range(0, n if low_bits else 0, _SLICE):
            bits = ((v[i:i + _SLICE, None] >> places) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(bits.ravel(), bitorder="little")
            low[i * low_bits // 8:i * low_bits // 8 + packed.size] = packed
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = int(ones[-1]) + 1 if n else 0
        unary = np.zeros(size, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return (_HEAD.pack(self.n, self.high.size, self.low_bits) + self.low.tobytes() + self.high.tobytes()
                + self.samples.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, high_size, low_bits = _HEAD.unpack_from(data)
        at, size = _HEAD.size, (n * low_bits + 7) // 8
        raw = np.frombuffer(data, np.uint8)
        low, high = raw[at:at + size], raw[at + size:at + size + high_size]
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at + size + high_size)
        return cls(n, low_bits, low, high, samples)

    def select(self, i: int) -> int:
        """Position of the ``i``-th one of the high part."""
        start = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # ones still to pass after the sampled one
        byte = start // 8
        bits = int(self.high[byte]) >> (start % 8) << (start % 8)
        while True:
            have = bits.bit_count()
            if have > left:
                break
            left -= have
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        return byte * 8 + (bits & -bits).bit_length() - 1

    def get(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = self.select(i) - i
        at = i * self.low_bits
        piece = int.from_bytes(self.low[at // 8:(at + self.low_bits + 7) // 8].tobytes(), "little") >> (at % 8)
        return value << self.low_bits | piece & ((1 << self.low_bits) - 1)

    def range(self, i: int, j: int) -> np.ndarray:
        """Values ``i`` to ``j`` (without it): two selects bound the stretch of the high
        part that holds them, and nothing else is unpacked."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.uint64)
        first, last = self.select(i), self.select(j - 1)
        byte = first // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte:last // 8 + 1], bitorder="little")) + byte * 8
        ones = ones[(ones >= first) & (ones <= last)]
        high = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        at, end = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[at // 8:(end + 7) // 8], bitorder="little")[at % 8:at % 8 + end - at]
        return high | (bits.reshape(j - i, -1).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(
            1, dtype=np.uint64)

    def all(self) -> np.ndarray:
        """All values at once."""
        return np.concatenate([self.range(i, min(self.n, i + _SLICE)) for i in range(0, max(self.n, 1), _SLICE)])
