"""Vectorised words: where the words of many texts start and end, and a 64-bit hash of each.

A word is a longest run of bytes other than ``0x20`` and ``0x09``-``0x0D``; in UTF-8 those bytes
only ever stand for themselves, so working on bytes equals working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Hashing walks the bytes in pieces of about this many, so a very long text needs no more memory.
PIECE = 1 << 20
#: Batches handed on by :func:`slices` hold about this many bytes of text (or one text).
BLOCK = 1 << 22

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words as the classifiers see them: letters, digits and all that is not ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_CACHE: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _CACHE or len(_CACHE[0]) < n:
        _CACHE[:] = _powers(max(n, PIECE + 4096))
    return _CACHE[0], _CACHE[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``block`` bytes of ``column``, or one row."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        col = b.column(b.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        part = np.cumsum(size) // block
        edges = np.flatnonzero(np.diff(part)) + 1
        for s, e in zip([0, *edges], [*edges, n], strict=True):
            yield b.slice(s, e - s)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the start of each text, with the end."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def find(data: np.ndarray, at: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each text (with the total).

    ``letters``: another table of the 256 bytes that make words.
    """
    inside = ~_SPACE[data] if letters is None else letters[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1]) if len(data) else None
    edge[at] = True  # a text's end parts words as white space does
    e = np.flatnonzero(edge)
    s, e = e[:-1], e[1:]
    if len(data) == 0:
        return s[:0], e[:0], np.zeros(len(at), np.int64)
    own = inside[s]
    s, e = s[own], e[own]
    return s, e, np.searchsorted(s, at, "left")


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased if asked)."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        a, b = int(start[i]), int(end[j - 1])
        part = data[a:b]
        if lower:
            part = _LOWER[part]
        up, down = powers(b - a + 1)
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each word on, where ``k`` words are left in the array."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out += word[j : j + n]
    return mix(out)


def release() -> None:
    """Give memory that is free back to the machine: workers wait between tasks, and executors are counted with them."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A task's function that releases memory when the task ends."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return out


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths laid end to end: the run of each item, and its place there."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - first[run] if len(run) else run
