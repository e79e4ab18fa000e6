"""Vectorised kernels over the texts of an Arrow batch: words, lines, rolling hashes, sums by row.

A batch's texts are one byte array and the offsets of its rows; a null text counts as empty. Memory grows with the
larger of ``PIECE`` and the longest single text, not with the batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
PIECE = 1 << 20

#: The ASCII white space that ends a word.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTES = np.random.default_rng(1234567).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have at most ``limit`` bytes together; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, low = np.cumsum(sizes), 0
        while low < len(sizes):
            before = ends[low] - sizes[low]
            high = max(low + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(low, high - low)
            low = high


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and the offsets of the rows in them."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return found, at - at[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words; ``first[r]`` to ``first[r + 1]`` are the words of row r."""
    black = ~WHITE[data]
    starts, ends = black.copy(), black.copy()
    starts[1:] &= ~black[:-1]
    ends[:-1] &= ~black[1:]
    filled = np.flatnonzero(np.diff(offsets))
    at, last = offsets[filled], offsets[filled + 1] - 1
    starts[at] = black[at]
    ends[last] = black[last]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between line feeds, and the row of each."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([offsets[1:], feeds]))
    per_row = np.diff(np.searchsorted(feeds, offsets)) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per_row)


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between one bound and the next."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_BASE, _INVERSE)):
            made = np.full(n + 1, base, np.uint64)
            made[0] = 1
            _powers[k] = np.multiply.accumulate(made)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes give equal hashes wherever they stand."""
    return _spans(_BYTES[data], starts, ends)


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _grown(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` consecutive values (64-bit integers or bytes)."""
    values = _BYTES[values] if values.dtype == np.uint8 else values
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _grown(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row of each element, from the bounds of the rows."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole(row: np.ndarray, width: int) -> np.ndarray:
    """True where a run of ``width`` elements stays within one row."""
    n = len(row) - width + 1
    return row[:n] == row[width - 1 :] if n > 0 else np.zeros(0, bool)


def covered(marked: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for each of n elements that lies in a marked run of ``width`` elements (runs named by their start)."""
    steps = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(marked)
    steps[at] += 1
    steps[at + width] -= 1  # starts are distinct, and so are ends
    return np.cumsum(steps[:n]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key found twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def later(keys: np.ndarray) -> np.ndarray:
    """True for each key equal to an earlier one."""
    order = np.argsort(keys, kind="stable")
    found = np.zeros(len(keys), bool)
    found[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return found
