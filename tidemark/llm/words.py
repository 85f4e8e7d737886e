"""Words of whole texts, and 64-bit hashes of words and word sequences, on UTF-8 bytes.

A word is a longest run of bytes other than space and ``\\t\\n\\v\\f\\r``. All of these are
single bytes in UTF-8, so the bytes need no decoding.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_SEED = 0x9E3779B97F4A7C55
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and row of every word."""
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each word's bytes; with ``lower`` A-Z count as a-z.

    A sum of scrambled (place in the word, byte) values: unlike a polynomial, whose values for words
    of regular patterns can agree whatever its base, no relation ties the values of two places.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    letters = raw[place + np.repeat(starts, lengths)]
    if lower:
        letters = _LOWER[letters]
    values = mix((place.astype(np.uint64) << np.uint64(8) | letters) + np.uint64(_SEED))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    hashes = sums[before + lengths] - sums[before]
    return mix(hashes + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window of ``width`` words inside one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    factor = 0x2545F4914F6CDD1D
    for k in range(width):
        out += hashes[k : k + n] * np.uint64(factor)
        factor = factor * 0xDA942042E4DD58B5 % 2**64 | 1
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mix(out[at] + np.uint64(width)), at


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)
