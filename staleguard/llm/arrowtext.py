"""Whole-batch numpy views of an Arrow string column: bytes, words, hashes, and the bounded pieces they are worked on in."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SPACE_BYTES = (9, 10, 11, 12, 13, 32)  # the word separators \x20 \x09-\x0D
PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as a null-free string array (null counts as the empty text)."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def pieces(lengths, limit: int = PIECE_BYTES):
    """Ranges [a, b) of consecutive rows of at most ``limit`` bytes together (a longer row stands alone)."""
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    a = 0
    while a < len(ends):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield a, b
        a = b


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a null-free large_string array; offsets start at 0."""
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    if len(col) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def byte_pieces(col: pa.Array, limit: int = PIECE_BYTES):
    """(a, b, bytes, offsets) for each piece of the column."""
    for a, b in pieces(np.diff(utf8(col)[1]), limit):
        yield a, b, *utf8(col.slice(a, b - a))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the splitmix64 step), on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=4)
def _letter_codes(fold_ascii: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold_ascii:
        codes[65:91] = codes[97:123]
    return codes


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, PIECE_BYTES + 1)
        for key, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_ascii: bool = False) -> np.ndarray:
    """64-bit hash of every byte range, from one prefix sum of position-weighted byte codes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letter_codes(fold_ascii)[data] * up[:len(data)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words of all rows; row r has words first[r]:first[r + 1]."""
    solid = np.ones(256, bool)
    solid[list(SPACE_BYTES)] = False
    inside = solid[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] |= inside[edges]  # a row that starts inside a run of letters starts a word
    starts = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[edges - 1] |= inside[edges - 1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_of(first: np.ndarray) -> np.ndarray:
    """Row number of each item, given the first item of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first) of all k-word windows inside rows; rows with fewer than k words have none."""
    n = np.diff(first)
    count = np.maximum(n - k + 1, 0)
    wfirst = np.concatenate([[0], np.cumsum(count)])
    if wfirst[-1] == 0:
        return np.zeros(0, np.uint64), wfirst
    at = np.arange(wfirst[-1]) + np.repeat(first[:-1] - wfirst[:-1], count)
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(_BASE) + hashes[at + i])
    return out, wfirst


def shingle_sets(col: pa.Array, k: int, fold_ascii: bool = True):
    """Yields (row, sorted distinct hashes of its k-word windows) for every row of the column.

    A row with fewer than k words has its whole word sequence as its only shingle; one without words has none.
    """
    for a, b, data, offsets in byte_pieces(col):
        starts, ends, first = word_ranges(data, offsets)
        words = range_hashes(data, starts, ends, fold_ascii)
        windows, wfirst = window_hashes(words, first, k)
        for r in range(b - a):
            got = windows[wfirst[r]:wfirst[r + 1]]
            if len(got) == 0 and first[r + 1] > first[r]:
                got = np.array([first[r + 1] - first[r]], np.uint64)
                for i in range(first[r], first[r + 1]):
                    got = mix(got * np.uint64(_BASE) + words[i:i + 1])
            yield a + r, np.unique(got)
