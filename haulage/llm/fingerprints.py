"""Hashes of words, shingles and windows, computed in whole arrays inside tasks.

Texts are taken from Arrow's buffers as they are: the words of many documents become one
array of hashes, with the place where each document begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PART_BYTES = 2 << 20  # documents are worked on together up to that size; longer ones alone
_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


_known: dict[tuple[int, int], np.ndarray] = {}


def multipliers(count: int, seed: int) -> np.ndarray:
    """Odd factors, the same in every task."""
    if (count, seed) not in _known:
        drawn = np.random.default_rng(seed).integers(1 << 62, 1 << 63, count, dtype=np.uint64)
        _known[count, seed] = drawn | np.uint64(1)
    return _known[count, seed]


def _byte_values(lower: bool) -> np.ndarray:
    values = multipliers(256, 1).copy()
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word (a bijection)."""
    values = values ^ (values >> _SHIFT)
    values *= _MIX_A
    values ^= values >> _SHIFT
    values *= _MIX_B
    values ^= values >> _SHIFT
    return values


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as Spark's longs."""
    return values.astype(np.uint64, copy=False).view(np.int64)


class Runs:
    """Hashes of ranges of an array that do not depend on where the range stands."""

    def __init__(self, values: np.ndarray):
        powers = np.full(len(values) + 1, _BACK, np.uint64)
        powers[0] = 1
        self.back = np.cumprod(powers)
        powers = np.full(len(values), _BASE, np.uint64)
        powers[:1] = 1
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * np.cumprod(powers), out=self.prefix[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[begin]) * self.back[begin]
        return mix(raw ^ mix((end - begin).astype(np.uint64)))


def parts(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last document, bytes and offsets of parts of an Arrow text column; a null text
    is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + PART_BYTES, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and each document's first word (one entry more than documents)."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~blank
    starts = inside.copy()
    starts[1:] &= blank[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]  # a word ends with its document
    begin = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= blank[1:]
    ends[first[1:] - 1] = inside[first[1:] - 1]
    end = np.flatnonzero(ends) + 1
    hashes = Runs(_byte_values(lower)[data]).of(begin, end)
    return hashes, np.searchsorted(begin, offsets)


def grams(hashes: np.ndarray, size: int, factors: np.ndarray) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = hashes[:n] * factors[0]
    for i in range(1, size):
        total += hashes[i : i + n] * factors[i]
    return mix(total)
