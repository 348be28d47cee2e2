"""Vectorised words, word hashes and shingles over the UTF-8 buffer of an Arrow column.

A word is a maximal run of letters, digits, marks outside ASCII and underscores after lower-casing;
ASCII punctuation and white space separate words.  All kernels work on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewell.llm._shared import CHUNK_BYTES

_U = np.uint64
#: Separates words: every ASCII byte that is no letter, digit or underscore.
SEPARATOR = np.array([b < 128 and not (chr(b).isalnum() or b == 95) for b in range(256)])
#: Odd, and 3 modulo 4, so that powers are invertible and neighbours don't commute.
_BASE = 0x9E3779B97F4A7C17 | 3
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base or of its inverse modulo 2**64, from 0 to n."""
    if len(_powers[kind]) <= n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        p = np.full(max(n + 1, 2 * len(_powers[kind])), base, _U)
        p[0] = 1
        _powers[kind] = np.multiply.accumulate(p)
    return _powers[kind]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``most`` bytes (one text at least), as large strings; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, column.slice(i, j - i)
        i = j


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large-string array without nulls, and the offsets of its texts."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    word = inside[at[:-1]]
    starts, ends = at[:-1][word], at[1:][word]
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans by prefix sums: equal spans have equal hashes wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * _power("up", n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", n)[starts] + (ends - starts).astype(_U))


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of each text, and the first shingle of each text (n + 1 values).

    A text of fewer than k words (but one at least) has one shingle of all its words.
    """
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    last = np.repeat(first[1:], count)
    padded = np.concatenate([words, np.zeros(k, _U)])
    h = np.zeros(len(at), _U)
    for j in range(k):
        w = padded[at + j]
        if (n < k).any():
            w = np.where(at + j < last, w, _U(0x5851F42D4C957F2D))
        h = (h ^ w) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
    return mix(h), begin


def hashed(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk of a text column: row of its first text, word hashes, and the first word of each text (n + 1 values)."""
    for at, part in chunks(column):
        data, offsets = buffers(pc.utf8_lower(part))
        starts, ends, first = word_spans(data, offsets)
        yield at, span_hashes(data, starts, ends), first


def shingled(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of a text column: row of its first text, shingle hashes, their starts, word counts."""
    for at, words, first in hashed(column):
        h, begin = shingles(words, first, k)
        yield at, h, begin, np.diff(first)
