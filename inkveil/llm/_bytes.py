"""Vectorised work on UTF-8 buffers inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base & _MASK, np.uint64)
        out[0] = 1
        have = _powers[base] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def give_back() -> None:
    """Return freed memory to the system: workers are kept between tasks, and their high-water marks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to do


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes; a longer row comes alone."""
    col = batch.column(column)
    col = (col if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else col.cast(pa.large_binary()))
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def unpacked(table: pa.Table | pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    """The values of a column of packed arrays, one after the other."""
    column = table.column(name)
    parts = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        wide = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        off = np.frombuffer(chunk.buffers()[1], wide)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, wide)
        if off[-1] > off[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[off[0] : off[-1]])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)).view(kind)


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary rows values[cuts[i]:cuts[i + 1]]."""
    values = np.ascontiguousarray(values)
    off = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(off), pa.py_buffer(values.view(np.uint8))])


def packed(name: str, key: np.ndarray, columns: list[tuple[str, str]], values: tuple, blob: tuple | None = None) -> pa.RecordBatch:
    """One row for each key with the values that have it, as bytes; blob: a name, bytes and how many each row has of them."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(order)])
    cuts = np.r_[first, len(order)]
    cols = [pa.array(ordered[first], pa.int32())] + [binaries(v[order].astype(kind), cuts) for v, (_, kind) in zip(values, columns, strict=True)]
    if blob:
        _, body, size = blob
        own = size[order]
        at = np.repeat((np.cumsum(size) - size)[order] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        cols.append(binaries(body[at], np.r_[0, np.cumsum(own)][cuts]))
    return pa.RecordBatch.from_arrays(cols, [name, *(c for c, _ in columns), *(blob[:1] if blob else ())])


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span, alike for alike contents wherever they stand."""
    n = len(values)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_BASE, n), out=run[1:])
    return mix((run[ends] - run[starts]) * powers(_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words of each row; no word crosses rows."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    here, before = solid[1:], solid[:-1]
    starts = np.flatnonzero(here & (~before | first))
    ends = np.flatnonzero(before & (~here | first))
    return starts, ends, np.diff(np.searchsorted(starts, off))


def word_hashes(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z lower-cased, and the number of words of each row."""
    starts, ends, n = words(data, off, separator)
    return span_hash(LOWER[data].astype(np.uint64) + np.uint64(1), starts, ends), n


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row its sorted distinct hashes of k consecutive words; fewer words are one shingle, none are none."""
    h, n = word_hashes(data, off)
    m = len(h)
    grams = np.zeros(max(0, m - k + 1), np.uint64)
    for j in range(k):
        grams = grams * np.uint64(_BASE) + h[j : j + len(grams)]
    grams = mix(grams)
    at = 0
    for c in n.tolist():
        if c >= k:
            yield np.unique(grams[at : at + c - k + 1])
        elif c:
            x = c
            for v in h[at : at + c].tolist():
                x = (x * _INV + v) & _MASK
            yield mix(np.array([x], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += c
