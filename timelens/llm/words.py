"""Words of whole Arrow text columns as numpy arrays: rows, byte ranges and 64-bit hashes.

Only A-Z are lowered. Every byte above 127 belongs to a word, so a class of code
points that keeps all non-ASCII characters is a class of bytes. Hashes depend on
nothing but the bytes, so all tasks agree on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
"""Text handled at a time; a longer text is a slice of its own."""

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False

ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Words(NamedTuple):
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a NULL is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes."""
    power, inverse = _power(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.take(_BYTE, data, out=sums[1:], mode="clip")
    sums[1:] *= power[:len(data)]
    np.cumsum(sums[1:], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """The maximal runs of bytes of `inside` in each row, in order, lowered and hashed."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    low = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    word = np.frombuffer(low.tobytes().translate(inside.tobytes()), bool)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    after = np.empty(n, bool)
    after[0] = False
    np.logical_and(word[:-1], ~edge[1:n], out=after[1:])
    starts = np.flatnonzero(word & ~after)
    before = np.empty(n, bool)
    before[-1] = False
    np.logical_and(word[1:], ~edge[1:n], out=before[:-1])
    ends = np.flatnonzero(word & ~before) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(np.repeat(np.arange(len(counts)), counts), starts, ends, hash_ranges(low, starts, ends))


_PLACE = mix(np.arange(1000, 1064, dtype=np.uint64) * _BASE) | np.uint64(1)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` hashes; runs of other sizes never share a formula."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, _PLACE[-size], np.uint64)
    for k in range(size):
        total += hashes[k:n + k] * _PLACE[k]
    return mix(total)


def shingles(found: Words, size: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle in order; a row with fewer words has one of all its words."""
    rows, hashes = found.rows, found.hashes
    grams = gram_hashes(hashes, size)
    whole = rows[:len(grams)] == rows[size - 1:] if len(grams) else np.zeros(0, bool)
    out_rows, out = rows[:len(grams)][whole], grams[whole]
    counts = np.bincount(rows, minlength=n_rows)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            total = np.full(len(short), _PLACE[-n], np.uint64)
            for k in range(n):
                total += hashes[firsts[short] + k] * _PLACE[k]
            out_rows, out = np.concatenate([out_rows, short]), np.concatenate([out, mix(total)])
    return out_rows, out


def row_groups(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets of each row's entries in an array sorted by row."""
    return np.searchsorted(rows, np.arange(n_rows + 1))
