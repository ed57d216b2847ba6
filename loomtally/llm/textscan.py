"""Vectorised scanning of text columns: words, their 64-bit hashes and word shingles, without a Python step per word."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa

_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MUL[1]
    x = (x ^ (x >> np.uint64(27))) * _MUL[2]
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Gives memory that is free in this process back to the system: a worker that waits for its next task then holds little."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row in them, with the end as the last; null is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def windows(column: pa.Array, size: int = 4 << 20):
    """Ranges of rows that hold about size bytes each: (first, last, bytes, offsets)."""
    data, bounds = text_bytes(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1))
        yield first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def find_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each row's first word, with the number of words as the last."""
    table = np.ones(256, np.bool_)
    table[[9, 10, 11, 12, 13, 32]] = False
    inside = np.empty(len(data) + 1, np.bool_)
    inside[:-1] = table[data]
    inside[-1] = False
    before = np.empty(len(data) + 1, np.bool_)
    before[0] = False
    before[1:] = inside[:-1]
    # A row's first byte begins a word, if any, whatever stands before it.
    edges = bounds[:-1][bounds[:-1] < bounds[1:]]
    cut = before[edges].copy()
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    before[edges] = cut
    ends = before & ~inside
    ends[edges] = cut
    ends = np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, eight bytes at a time over all ranges that are still open."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    masks = np.array([0, *((1 << (8 * k)) - 1 for k in range(1, 9))], np.uint64)
    left = ends - starts
    out = mix(left.astype(np.uint64) * _MUL[0] + np.uint64(1))
    at, going = starts.copy(), np.arange(len(starts))
    long = left > 512
    if long.any():
        import xxhash

        for i in np.flatnonzero(long):
            out[i] = np.uint64(xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=0x51))
        going = np.flatnonzero(~long)
    while len(going):
        rest = left[going]
        value = eights[at[going]] & masks[np.minimum(rest, 8)]
        out[going] = mix((out[going] ^ value) * _MUL[0])
        at[going] += 8
        left[going] = rest - 8
        going = going[rest > 8]
    return out


def shingle_sets(words: np.ndarray, firsts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's shingles, one row after another, and where each row begins. A row with fewer words than
    width has its whole sequence as one shingle; a row without words has none."""
    n = len(words)
    count = np.diff(firsts)
    if n >= width:
        run = n - width + 1
        h = mix(words[:run] + np.uint64(width))
        for k in range(1, width):
            h = mix(h * _MUL[0] + words[k : k + run])
    else:
        h = np.zeros(0, np.uint64)
    parts, sizes = [], np.zeros(len(count), np.int64)
    for i, c in enumerate(count):
        a = firsts[i]
        if c >= width:
            x = np.sort(h[a : a + c - width + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif c:
            one = mix(words[a : a + 1] + np.uint64(c))
            for k in range(1, c):
                one = mix(one * _MUL[0] + words[a + k : a + k + 1])
            x = one
        else:
            continue
        parts.append(x)
        sizes[i] = len(x)
    bounds = np.zeros(len(count) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds
