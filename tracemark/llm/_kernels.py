"""Vectorised byte-level text kernels shared by the operators of this subpackage.

All functions take the raw UTF-8 buffer of an Arrow string column and its offsets, so a batch of
texts is handled by a fixed number of numpy calls, never by a Python loop over characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(0x5EED)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_POW = {_BASE: np.ones(1, U64), _INV: np.ones(1, U64)}


def release_memory() -> None:
    """Give freed memory back to the system: workers live on, and their peaks shouldn't add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy_stream(task):
    """A mapInArrow function that releases its memory at its end."""

    def go(batches):
        yield from task(batches)
        release_memory()

    return go


def tidy_group(task):
    """The same for a function of one table."""

    def go(table: pa.Table) -> pa.Table:
        out = task(table)
        release_memory()
        return out

    return go


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    have = _POW[base]
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 2**64))])
    _POW[base] = have if len(have) <= 1 << 24 else _POW[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = 1 << 20, rows: int = 4000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``rows`` texts and about ``limit`` bytes (a longer text comes alone)."""
    _, off = text_buffer(column)
    at, n = 0, len(off) - 1
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        end = min(max(end, at + 1), at + rows, n)
        yield at, end
        at = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words up to each text's begin) of the runs without ASCII white space."""
    n = len(data)
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run: a polynomial by prefix sums, made position free and mixed."""
    n = len(data)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODE[data] * powers(_BASE, n), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(U64) * MULT[60])


def word_gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive entries of h."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for j in range(n):
        out += h[j : j + m] * MULT[j]
    return mix(out)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets by text): words lower-cased in ASCII.

    A text of fewer than n words is one shingle, its whole sequence; one without words has none.
    At most 4095 texts a call.
    """
    data, off = text_buffer(column)
    data = LOWER[data]
    starts, ends, at = words(data, off)
    h = word_hashes(data, starts, ends)
    count = np.diff(at)
    texts = np.arange(len(count))
    owner = np.repeat(texts, count)
    grams = word_gram_hashes(h, n)
    inside = owner[: len(grams)] == owner[len(h) - len(grams) :] if len(grams) else np.zeros(0, bool)
    grams, of = grams[inside], owner[: len(grams)][inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = np.array([sum((int(h[at[t] + j]) * int(MULT[j]) for j in range(count[t])), int(count[t]) * int(MULT[61])) % 2**64 for t in short], U64)
        grams, of = np.concatenate([grams, mix(own)]), np.concatenate([of, short])
    order = np.argsort((of.astype(U64) << U64(52)) | (grams >> U64(12)))
    grams, of = grams[order], of[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[keep], of[keep]
    return grams, np.searchsorted(of, np.arange(len(count) + 1))
