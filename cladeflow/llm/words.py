"""Words, lines and n-grams of a column of texts, as arrays.

Texts of an Arrow column lie end to end in one buffer. Words are found and
hashed over the whole buffer at once, with numpy. Separators are ASCII, and no
byte of a longer UTF-8 sequence is ASCII, so bytes serve as well as characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text goes alone.
SLICE_BYTES = 4 << 20

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Everything ASCII but digits and lower-case letters.
NOT_ALNUM = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_SPAN = 64
_random = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _random.integers(0, 2**64, size=_SPAN * 256, dtype=np.uint64)
_FACTORS = _random.integers(0, 2**64, size=64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of some texts: place of each in the buffer, hash, and texts' ranges."""

    first: np.ndarray
    last: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i] to bounds[i + 1]

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array):
    """(first row, part of the column) of some SLICE_BYTES each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, at = raw(column)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(at, at[begin] + SLICE_BYTES, "right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield begin, column.slice(begin, end - begin)
        begin = end


def cut(column: pa.Array, separators: bytes, lower: bool = False) -> Words:
    """Longest runs without a separator, in each text of `column`."""
    data, at = raw(column)
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    if lower:
        data = _LOWER[data]
    inside = inside[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64))
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(first):
        return Words(first, last, np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64))
    size = last - first
    used = np.flatnonzero(inside)
    place = np.arange(len(used)) - np.repeat(np.cumsum(size) - size, size)
    value = _TABLE[((place & (_SPAN - 1)) << 8) + data[used]]
    if size.max() > _SPAN:
        value = value * ((place // _SPAN) * 2 + 1).astype(np.uint64)
    hashes = mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))
    return Words(first, last, hashes, np.searchsorted(first, at))


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they lie in one text."""
    h = words.hashes
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = h[:m] * _FACTORS[0]
    for i in range(1, n):
        total = total + h[i : i + m] * _FACTORS[i % 64] * np.uint64(2 * (i // 64) + 1)
    owner = words.owner()
    return mix(total), owner[:m] == owner[n - 1 :]
