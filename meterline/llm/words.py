"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

Separators are ASCII bytes, so cutting UTF-8 at them never splits a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


# Word bytes: all but white space; and all but ASCII other than 0-9 and a-z (A-Z count as a-z).
SPACED = _separators((0x20, 0x20), (0x09, 0x0D))
ALNUM = _separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if places is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes: first row, end row, bytes, offsets.

    Memory follows the slice, or the longest single text, not the batch.
    """
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_counts(word_bytes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words each row has; none reaches over the end of a row."""
    starts = word_bytes[data]
    heads = offsets[offsets < len(data)]
    first = starts[heads]
    starts[1:] &= ~starts[:-1]
    starts[heads] = first
    return np.diff(np.searchsorted(np.flatnonzero(starts), offsets))


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


class WordReader:
    """Cuts texts into words and gives each a 64-bit hash.

    A word's hash is a polynomial over random values of its bytes, read off two
    running sums, so all words of a slice are hashed by a few array operations.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, word_bytes: np.ndarray, fold: bool):
        self.is_word = word_bytes.copy()
        values = constants(256, 7)
        if fold:
            values[65:91] = values[97:123]
            self.is_word[65:91] = self.is_word[97:123]
        self.values = values
        self._powers(1 << 19)

    def _powers(self, n: int) -> None:
        def run(base: int) -> np.ndarray:
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        self.power, self.inverse = run(self.BASE), run(pow(self.BASE, -1, 1 << 64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        if len(values) > len(self.power):
            self._powers(2 * len(values))
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=total[1:])
        return total

    def span_hash(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.inverse[start])

    def read(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        inside = self.is_word[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        before[offsets] = False
        after[offsets] = False
        start = np.flatnonzero(inside & ~before[:-1])
        end = np.flatnonzero(inside & ~after[1:]) + 1
        row = np.searchsorted(offsets, start, "right") - 1
        return Words(start, end, row, self.span_hash(self.sums(self.values[data]), start, end))


def runs(hashes: np.ndarray, rows: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` consecutive words in one row, and where each starts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(rows[: len(rows) - k + 1] == rows[k - 1 :])
    factors = constants(k, seed)
    total = hashes[:n] * factors[0]
    for j in range(1, k):
        total += hashes[j : n + j] * factors[j]
    return mix(total[at]), at


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each UTF-8 character, the rows' offsets in characters, and where each starts."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), offsets, np.arange(len(data))
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.r_[lead, len(data)])
    value = data[lead].astype(np.uint32)
    more = np.flatnonzero(size > 1)
    for j in range(1, 4):
        more = more[size[more] > j]
        value[more] |= data[lead[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return value, np.searchsorted(lead, offsets), lead
