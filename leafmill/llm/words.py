"""Vectorised word scanning and hashing over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; texts are
handled as UTF-8, so the byte rule and the code point rule agree.  Everything
works on whole Arrow buffers with numpy: no Python object per word is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALTED = (np.arange(256, dtype=U64) + U64(1)) * U64(0xD6E8FEB86659FD93)

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _table(size: int) -> list[np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, grown on demand."""
    if len(_powers[0]) < size:
        size = max(size, 1 << 20)
        for slot, base in enumerate((_RADIX, _INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[slot] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """The words of a run of texts: byte ranges in ``data`` and text bounds.

    ``first[t]:first[t + 1]`` are the words of text t.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, seed: int = 0) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        power, inverse = _table(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_SALTED[self.data] * power[: len(self.data)], out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * inverse[self.start]
        return mix(value + U64((seed * 0xA24BAED4963EE407 + 0x632BE59BD9B4E019) % (1 << 64)))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, bounds, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if bounds is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(bounds, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    bound = np.zeros(n + 1, dtype=bool)
    bound[offsets] = True
    # A word begins where a word byte follows a space or a text's bound, and ends likewise.
    begins = inside[1:] & (~inside[:-1] | bound)
    ends = inside[:-1] & (~inside[1:] | bound)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(data, start, end, np.searchsorted(start, offsets))


def runs(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    data, offsets = text_of(column)
    at = 0
    while at < len(offsets) - 1:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, upto, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def grams(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` hashes, in order; text bounds are the caller's business."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    by = U64((_RADIX * (2 * seed + 3)) % (1 << 64) | 1)
    total, done = np.zeros(n, U64), 0
    block, width, left = hashes, 1, size
    factor = by
    while left:  # doubling: block holds polynomial hashes of width hashes
        if left & 1:
            total = total * _power(int(by), width) + block[done : done + n]
            done += width
        left >>= 1
        if left:
            block = block[:-width] * factor + block[width:]
            factor = _power(int(factor), 2)
            width *= 2
    return mix(total + U64(size))


def _power(base: int, exponent: int) -> np.uint64:
    return U64(pow(base, exponent, 1 << 64))


def group_of(words: Words, size: int) -> np.ndarray:
    """For each window of ``size`` words, the index of its text, or -1 where it crosses a bound."""
    n = len(words.start) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts())
    return np.where(owner[:n] == owner[size - 1 :], owner[:n], -1)
