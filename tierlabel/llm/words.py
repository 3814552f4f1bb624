"""Words, lines and windows of Arrow text columns as numpy arrays, for use inside tasks.

Everything works on the UTF-8 bytes of a whole batch at once. A word or line is known by a 64-bit hash: a polynomial
over a table of random numbers per byte, taken from running sums, and mixed. Memory follows the batch that Spark
sends (bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``), hashing goes in segments of a quarter of a megabyte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

_SEGMENT = 1 << 18
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


@dataclass(frozen=True)
class Pieces:
    """Words or lines of several texts, one after the other."""

    hashes: np.ndarray  # uint64
    bounds: np.ndarray  # piece numbers at which each text starts, and the end
    starts: np.ndarray  # byte positions in ``data``
    ends: np.ndarray
    data: np.ndarray  # the bytes of all texts
    offsets: np.ndarray  # byte positions at which each text starts, and the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """The number of the text of each piece."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def blocks(texts: pa.Array, limit: int = _BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """Slices of at most ``limit`` bytes (or one text), each with the number of its first text."""
    _, offsets = _bytes(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, texts.slice(first, last - first)
        first = last


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each text starts; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@cache
def _table(lower: bool) -> np.ndarray:
    values = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    return values


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        steps = np.full(_SEGMENT, base, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    table, (powers, inverse) = _table(lower), _powers()
    first = 0
    while first < len(starts):
        at = starts[first]
        last = int(np.searchsorted(ends, at + _SEGMENT, side="right"))
        if last <= first:  # a piece longer than a segment: its segments' hashes are chained
            value = np.zeros(1, np.uint64)
            for a in range(at, ends[first], _SEGMENT):
                part = table[data[a : min(a + _SEGMENT, ends[first])]]
                value = mix(value + (part * powers[: len(part)]).sum(dtype=np.uint64))
            out[first] = value[0]
            first += 1
            continue
        part = table[data[at : ends[last - 1]]]
        part *= powers[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        s, e = starts[first:last] - at, ends[first:last] - at
        out[first:last] = (sums[e] - sums[s]) * inverse[s]
        first = last
    return mix(out + (ends - starts).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


def _pieces(texts: pa.Array, separators: bytes, lower: bool) -> Pieces:
    data, offsets = _bytes(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Pieces(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none, data, offsets)
    is_separator = np.zeros(256, bool)
    is_separator[list(separators)] = True
    outside = is_separator[data]
    edges = offsets[:-1][np.diff(offsets) > 0]  # first bytes of texts
    begins = ~outside
    begins[1:] &= outside[:-1]
    begins[edges] = ~outside[edges]
    finishes = ~outside
    finishes[:-1] &= outside[1:]
    finishes[edges[1:] - 1] = ~outside[edges[1:] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    bounds = np.searchsorted(starts, offsets)
    return Pieces(_hash(data, starts, ends, lower), bounds, starts, ends, data, offsets)


def words(texts: pa.Array, lower: bool = False) -> Pieces:
    """Runs of anything but the six ASCII white-space characters; ``lower`` takes A-Z as a-z."""
    return _pieces(texts, b" \t\n\r\x0b\x0c", lower)


def lines(texts: pa.Array) -> Pieces:
    """Runs of anything but line feeds; empty lines do not appear."""
    return _pieces(texts, b"\n", False)


def windows(pieces: Pieces, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of ``width`` words of one text, and the number of its first word."""
    n = len(pieces.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for i in range(width):
        value = value * _U(_BASE) + pieces.hashes[i : i + n]
    # the last width - 1 words of a text start no window
    inside = np.ones(n, bool)
    for end in range(width - 1):
        at = pieces.bounds[1:] - 1 - end
        at = at[(at >= pieces.bounds[:-1]) & (at < n)]
        inside[at] = False
    first = np.flatnonzero(inside)
    return mix(value[first]), first


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of an array over the stretch of each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
