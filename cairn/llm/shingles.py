"""Words of many texts at once, as hashes in numpy arrays.

A batch of texts is one byte buffer.  Words are maximal runs of bytes that are
not ASCII white space; a word's hash is a polynomial in its bytes, taken from
prefix sums modulo 2**64 and then mixed.  Batches are cut so that temporary
arrays stay small; only a single longer text makes a longer piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
PIECE = 1 << 20

_U = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BARE = _FOLDED.copy()
_BARE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 0
_BASES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; the base is odd."""
    if base not in _BASES or len(_BASES[base][0]) < n:
        size = max(n, PIECE + 4096)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _BASES[base] = (pair[0], pair[1])
    a, b = _BASES[base]
    return a[:n], b[:n]


def rolling(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of the k words from each position on; shorter than words by k - 1."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])


@dataclass
class Piece:
    """Some consecutive texts of a batch: rows low..high, their words' hashes, and where each text's words begin."""

    low: int
    high: int
    data: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __iter__(self):
        """(row, first word, word after the last) of each text."""
        return zip(range(self.low, self.high), self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)


def _layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8), offsets


def pieces(column: pa.Array, fold: bool = False, bare: bool = False, size: int = PIECE) -> Iterator[Piece]:
    """The texts of an Arrow string column (null: no words), about ``size`` bytes at once; ``fold`` lower-cases A to Z, ``bare`` also ignores ASCII punctuation at a word's end."""
    data, offsets = _layout(column)
    table, low, n = (_BARE if bare else _FOLDED if fold else _BYTE), 0, len(column)
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        high = min(high, n)
        own = data[offsets[low] : offsets[high]]
        at = offsets[low : high + 1] - offsets[low]
        if not len(own):
            none = np.zeros(0, np.int64)
            yield Piece(low, high, own, np.zeros(0, np.uint64), none, none, np.zeros(high - low + 1, np.int64))
            low = high
            continue
        space = (own == 32) | (own - np.uint8(9) < 5)
        begins = ~space
        ends = begins.copy()
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        full = at[:-1][at[1:] > at[:-1]]
        begins[full] = ~space[full]
        last = at[1:][at[1:] > at[:-1]] - 1
        ends[last] = ~space[last]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = powers(0x9E3779B97F4A7C15, len(own) + 1)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(table[own] * up[: len(own)], out=sums[1:])
        yield Piece(low, high, own, mix((sums[e] - sums[s]) * down[s]), s, e, np.searchsorted(s, at))
        low = high


def shingle_sets(piece: Piece, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted hashes; with fewer words the whole sequence is one."""
    grams = rolling(piece.words, k, 0xD1342543DE82EF95)
    out = []
    for _, a, b in piece:
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif b > a:
            out.append(rolling(piece.words[a:b], b - a, 0xD1342543DE82EF95) ^ _U(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
