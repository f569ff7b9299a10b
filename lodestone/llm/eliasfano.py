"""Elias-Fano code of a non-decreasing sequence with a sampled select structure.

n values up to U take about n * (2 + log2(U / n)) bits: the low l bits of every value packed, the high parts as set bits
i + (value >> l) of one bit vector. Value i is found by select(i): start at the sampled place of the last multiple of
EVERY ones, count ones word by word, then pick the bit.
"""

from __future__ import annotations

import struct

import numpy as np

#: Ones between two samples.
EVERY = 512
_HEAD = struct.Struct("<QQIIQQ")


class EliasFano:
    def __init__(self, n: int, top: int, low_bits: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.high, self.low, self.samples = n, top, low_bits, high, low, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(place[-1]) + 1 if n else 0) // 64) * 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        low = np.zeros(0, "<u8")
        if low_bits and n:
            shifts = np.arange(low_bits, dtype=np.uint64)
            flat = np.zeros(-(-n * low_bits // 64) * 64, np.uint8)
            step = 1 << 20
            for a in range(0, n, step):
                part = values[a : a + step]
                flat[a * low_bits : (a + len(part)) * low_bits] = ((part[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
            low = np.packbits(flat, bitorder="little").view("<u8")
        return cls(n, top, low_bits, high, low, place[::EVERY].astype("<u8"))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.top, self.low_bits, len(self.samples), len(self.high), len(self.low))
        return head + self.high.tobytes() + self.low.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, low_bits, samples, high, low = _HEAD.unpack_from(data)
        at, out = _HEAD.size, []
        for count, kind in ((high, "<u8"), (low, "<u8"), (samples, "<u8")):
            out.append(np.frombuffer(data, kind, count, at))
            at += count * int(kind[2])
        return cls(n, top, low_bits, *out)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        word, bit = divmod(i * self.low_bits, 64)
        both = int(self.low[word]) | (int(self.low[word + 1]) << 64 if word + 1 < len(self.low) else 0)
        return both >> bit & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Place of the i-th one (from 0) in the high bits."""
        word, bit = divmod(int(self.samples[i // EVERY]), 64)
        bits, left = int(self.high[word]) >> bit << bit, i % EVERY
        while left >= (ones := bits.bit_count()):
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return (self.select(i) - i) << self.low_bits | self._low(i)

    def __len__(self) -> int:
        return self.n

    def all(self) -> np.ndarray:
        place = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")).astype(np.int64)
        out = (place - np.arange(self.n)) << self.low_bits
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low.view(np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out
