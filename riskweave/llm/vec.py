"""Vectorised word and line hashing over Arrow text columns (small helpers for the Python stages)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BREAKS = np.zeros(256, bool)
BREAKS[[0x0A, 0x0D]] = True

_SLICE = 1 << 18
_STEP = 0x9E3779B97F4A7C15
_UNSTEP = pow(_STEP, -1, 1 << 64)
BYTES = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OTHER_BYTES = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_BYTES = BYTES.copy()
LOWER_BYTES[65:91] = BYTES[97:123]
_pow: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit sums so that every bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, _SLICE + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 22:
            _pow[base] = have
    return have


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string (or binary) column (null: empty) and the offset of every row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[offs[0] : offs[-1]], offs - offs[0]) if len(offs) else (raw[:0], np.zeros(1, np.int64))


def spans(offs: np.ndarray, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes each; a longer row stands alone."""
    out, at = [], 0
    while at < len(offs) - 1:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        out.append((at, to))
        at = to
    return out


def split(data: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every unit between separators, and each row's first unit."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~separators[data]
    first = offs[:-1]
    first = first[(first > 0) & (first < len(data))]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """A 64-bit hash of the bytes of every unit."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SLICE, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * _powers(_STEP, high - low)[: high - low], out=sums[1:])
        head = starts[at:to] - low
        out[at:to] = (sums[ends[at:to] - low] - sums[head]) * _powers(_UNSTEP, high - low)[head]
        at = to
    return mix(out)


def windows(units: np.ndarray, k: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of each k consecutive units, rows not regarded."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = units[:n].copy()
    for i in range(1, k):
        total *= np.uint64(factor)
        total += units[i : i + n]
    return mix(total)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """For each start of k consecutive units, whether one row holds them all."""
    n = max(0, int(first[-1]) - k + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return owner[:n] == owner[k - 1 : k - 1 + n]


def strings(blobs: list[bytes | None]) -> pa.Array:
    return pa.array(blobs, pa.binary())
