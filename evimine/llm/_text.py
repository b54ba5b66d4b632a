"""Vectorised words and word windows of Arrow text columns.

A word is a maximal run of bytes outside space and 0x09-0x0D; those bytes are ASCII, so cutting UTF-8 at them is the
same as cutting its characters. Words are named by 64-bit hashes: a polynomial over random byte values, finished by a
mixer. Everything works on chunks of about a megabyte, so memory does not grow with the batch or the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 10_000

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
IS_WORD = ~_SPACES
_RNG = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE_LOWER = _VALUE[_LOWER]
_FACTORS = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


class _Powers:
    """base**0, base**1, ... modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(pow(self.base, len(self.values), 2**64))
            self.values = np.concatenate([self.values, self.values * step])
        return self.values


_POWERS, _INVERSES = _Powers(_BASE), _Powers(_BASE_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Chunk(NamedTuple):
    """Rows low..high of an array: their bytes, and where each row starts in them (one more than rows)."""

    low: int
    high: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole rows, about limit bytes and at most CHUNK_ROWS at a time. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = min(n, low + CHUNK_ROWS, max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1))
        yield Chunk(low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


class Words(NamedTuple):
    """Byte ranges of a chunk's words, and the index of each row's first word (one more than rows)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(chunk: Chunk) -> Words:
    size, edges = len(chunk.data), chunk.offsets
    inside = IS_WORD[chunk.data]
    joined = np.zeros(size + 1, bool)  # whether the bytes on both sides of a place belong to one word
    if size:
        joined[1:size] = inside[:-1] & inside[1:]
        joined[edges] = False
    starts = np.flatnonzero(inside & ~joined[:-1])
    ends = np.flatnonzero(inside & ~joined[1:]) + 1
    return Words(starts, ends, np.searchsorted(starts, edges))


def hashes(chunk: Chunk, found: Words, lower: bool) -> np.ndarray:
    """64-bit names of the words, optionally after lower-casing A-Z."""
    value = _VALUE_LOWER if lower else _VALUE
    out = np.empty(len(found.starts), np.uint64)
    low = 0
    while low < len(out):
        base = int(found.starts[low])
        high = max(low + 1, int(np.searchsorted(found.ends, base + CHUNK_BYTES, "right")))
        span = value[chunk.data[base : found.ends[high - 1]]]
        span *= _POWERS.upto(len(span))[: len(span)]
        total = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(span, out=total[1:])
        starts, ends = found.starts[low:high] - base, found.ends[low:high] - base
        out[low:high] = (total[ends] - total[starts]) * _INVERSES.upto(len(span))[starts]
        low = high
    return mix(out)


def combine(names: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Names of every run of width consecutive entries, row borders ignored."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(width + 977 * salt), np.uint64)
    for i in range(width):
        total += names[i : i + n] * _FACTORS[(i + 17 * salt) % len(_FACTORS)]
    return mix(total)


def windows(names: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, name and row of every run of width words that lies in one row."""
    all_names = combine(names, width)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.arange(len(all_names))
    keep = starts + width <= first[1:][rows[: len(all_names)]] if len(all_names) else np.zeros(0, bool)
    return starts[keep], all_names[keep], rows[: len(all_names)][keep]


def per_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive edges."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[edges])


def text_at(chunk: Chunk, row: int) -> bytes:
    return chunk.data[chunk.offsets[row] : chunk.offsets[row + 1]].tobytes()
