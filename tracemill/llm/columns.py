"""Arrow columns as flat byte arrays, and words and shingles over them without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles, and rows; a longer single text makes a step of its own. A worker takes some 100 bytes for each of them.
STEP_BYTES, STEP_ROWS = 1 << 18, 256
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def table_of(separators: bytes) -> np.ndarray:
    """A lookup of the bytes that separate words."""
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and where each row starts and ends in it. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first = int(offsets[0])
    size = int(offsets[-1]) - first
    return (np.frombuffer(data, np.uint8, size, first) if size else np.zeros(0, np.uint8)), offsets - first


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes, one row at least and `STEP_ROWS` at most."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = min(low + STEP_ROWS, max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1))
        yield low, high
        low = high


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it (one more entry than rows)."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps_ = np.full(n, base, np.uint64)
            steps_[0] = 1
            _powers[k] = np.multiply.accumulate(steps_)
    return _powers[0][:n], _powers[1][:n]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: differences of a running polynomial, taken block by block."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        base = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, base + STEP_BYTES, "right")))
        block = data[base : int(ends[high - 1])]
        up, down = _power_tables(len(block) + 1)
        running = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[:-1], out=running[1:])
        s, e = starts[low:high] - base, ends[low:high] - base
        out[low:high] = (running[e] - running[s]) * down[s]
        low = high
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of `width` words; of all its words, if it has fewer; none without words."""
    starts, ends, before = words(data, offsets, separator)
    hashes = hash_words(data, starts, ends)
    count = max(0, len(hashes) - width + 1)
    joined = np.zeros(count, np.uint64)
    for k in range(width):
        joined = mix(joined + hashes[k : k + count] + np.uint64(k + 1))
    for low, high in zip(before[:-1], before[1:], strict=True):
        if high - low >= width:
            yield np.unique(joined[low : high - width + 1])
        elif high > low:
            one = np.zeros(1, np.uint64)
            for k in range(low, high):
                one = mix(one + hashes[k] + np.uint64(k - low + 1))
            yield one
        else:
            yield np.zeros(0, np.uint64)
