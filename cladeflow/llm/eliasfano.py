"""Elias-Fano encoding of non-decreasing integers, with select samples.

n values below a universe u take n * (2 + log2(u / n)) bits and a little for
the samples. The low bits of each value stand packed in one array; the high
bits in a unary bit vector, where value i sets bit (high + i). Every SAMPLE-th
set bit has its place noted, so that a value is found by a scan over a few
bytes and not over the whole vector.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64
_HEAD = struct.Struct("<QQB")
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


def encode(values: np.ndarray) -> bytes:
    """Bytes for `values`, non-decreasing and not negative; may be empty."""
    v = np.asarray(values, dtype=np.int64)
    n = len(v)
    if n and (v[0] < 0 or (np.diff(v) < 0).any()):
        raise ValueError("values must be non-decreasing and not negative")
    universe = int(v[-1]) + 1 if n else 0
    low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
    low = ((v[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
    places = (v >> low_bits) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
    high[places] = 1
    parts = [
        _HEAD.pack(n, universe, low_bits),
        np.packbits(low.ravel(), bitorder="little").tobytes(),
        np.packbits(high, bitorder="little").tobytes(),
        places[::SAMPLE].astype("<u4" if n and places[-1] < 2**32 else "<u8").tobytes(),
    ]
    return parts[0] + b"".join(struct.pack("<Q", len(p)) + p for p in parts[1:])


class EliasFano:
    """Reads what encode() wrote, by index."""

    def __init__(self, data: bytes):
        self.n, self.universe, self.low_bits = _HEAD.unpack_from(data)
        at, parts = _HEAD.size, []
        for _ in range(3):
            (size,) = struct.unpack_from("<Q", data, at)
            parts.append(data[at + 8 : at + 8 + size])
            at += 8 + size
        self.low = np.frombuffer(parts[0], np.uint8)
        self.high = np.frombuffer(parts[1], np.uint8)
        count = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(parts[2], f"<u{len(parts[2]) // count}" if count else "<u4")

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Place in the high bits of the i-th set bit."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while left >= (ones := int(_POPCOUNT[word])):
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.low_bits
        low = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little")
        low = low >> (first & 7) & ((1 << self.low_bits) - 1)
        return (self.select(i) - i) << self.low_bits | low

    def values(self) -> np.ndarray:
        """All values; one scan over the bits."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits]
        low = bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return ((places - np.arange(self.n)) << self.low_bits) | low
