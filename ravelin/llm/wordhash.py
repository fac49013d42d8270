"""Words of Arrow text batches as 64-bit hashes, computed with whole-array numpy steps inside Spark tasks.

A text is never turned into Python strings: words are found on the UTF-8 bytes (all separators used here are ASCII, so bytes of other
characters are word bytes), A-Z is lower-cased on the bytes, and each word gets a polynomial hash over random 64-bit byte values, mixed.
Batches are cut into slices of bounded bytes, so memory doesn't grow with the batch; one very long text is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
#: Odd multipliers for windows of words.
_DRAWN = np.random.Generator(np.random.PCG64(20240611)).integers(1 << 62, 1 << 64, 4096, dtype=U64)
BYTE_VALUES = _DRAWN[:256] | U64(1)
STEPS = _DRAWN[256:512] | U64(1)
BASE = int(_DRAWN[512]) | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256: True where the byte separates words."""
    flags = np.zeros(256, bool)
    for first, last in ranges:
        flags[first:last + 1] = True
    return flags


#: `[^\x20\x09-\x0D]+`
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
NON_WORD = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of at most ``limit`` bytes, or of one longer row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, where, content = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        stop = min(stop, n)
        yield start, stop, data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start]
        start = stop


@dataclass
class Words:
    """Words of a slice in order: hash, row within the slice, and per row the index of its first word (n_rows + 1 values)."""

    hashes: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(data: np.ndarray, offsets: np.ndarray, is_separator: np.ndarray) -> Words:
    n_rows, n = len(offsets) - 1, len(data)
    if not n:
        return Words(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(n_rows + 1, np.int64))
    lowered = np.arange(256, dtype=np.uint8)
    lowered[65:91] += 32
    low = lowered[data]
    inside = ~is_separator[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUES[low] * powers(BASE, n), out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * powers(BASE_INVERSE, n)[start])
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets)
    return Words(hashes, row, first)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within a row, and the index of its first word."""
    n = len(words.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    for i in range(size):
        total += words.hashes[i:i + n] * STEPS[i]
    at = np.flatnonzero(words.row[:n] == words.row[size - 1:size - 1 + n])
    return mix(total[at] ^ U64(size)), at
