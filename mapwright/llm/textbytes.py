"""Words of whole Arrow string batches as numpy arrays, without per-word Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def keys(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random multipliers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_PLACES = keys(512, 11)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows + end) of runs of rows of about ``most`` bytes.

    A row longer than that is a run of its own; nulls are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word of a run of rows."""
    inside = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    before = np.empty(len(buf), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words: multilinear in the bytes, with one key per place."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    total = int(length.sum())
    first = np.cumsum(length) - length
    place = np.arange(total) - np.repeat(first, length)
    if int(length.max()) > len(_PLACES):
        keyed = np.where(place < len(_PLACES), _PLACES[place % len(_PLACES)], mix64(place.astype(np.uint64)) | np.uint64(1))
    else:
        keyed = _PLACES[place]
    byte = buf[place + np.repeat(start, length)]
    if lower:
        byte = _LOW[byte]
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((byte.astype(np.uint64) + np.uint64(1)) * keyed, first)
        return mix64(sums + length.astype(np.uint64) * _LENGTH)


def runs(word_hash: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Hashes of the k-word runs that begin at each place (len - k + 1 of them)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    q = keys(k, seed)
    with np.errstate(over="ignore"):
        total = word_hash[:n] * q[0]
        for j in range(1, k):
            total += word_hash[j : j + n] * q[j]
        return mix64(total)
