"""Vectorised byte work on many texts at once: joined buffers, word bounds, polynomial and rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
#: One random 64-bit value for each byte.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after another, and the n + 1 offsets; null counts as empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        n = max(n, 3 << 19)
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, _BASE, U)]))
            _INVERSES = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, _INVERSE, U)]))
    return _POWERS, _INVERSES


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers of the base, so that any span's hash is a difference."""
    powers, _ = _tables(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=out[1:])
    return out


def value_sums(values: np.ndarray) -> np.ndarray:
    """As ``prefix_sums``, of 64-bit values instead of bytes."""
    powers, _ = _tables(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverses = _tables(len(sums))
    return mix((sums[end] - sums[begin]) * inverses[begin] + (end - begin).astype(U))


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every span of ``width`` bytes, by its start."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, U)
    _, inverses = _tables(len(sums))
    return mix((sums[width:] - sums[:n]) * inverses[:n])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each ASCII-space-separated word, and how many words stand before each text's start."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edge = inside[1:] != inside[:-1]
    begin_at = edge & inside[1:]
    end_at = edge & inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]  # a word may not run over into the next text
    begin_at[both] = True
    end_at[both] = True
    begin, end = np.flatnonzero(begin_at), np.flatnonzero(end_at)
    return begin, end, np.searchsorted(begin, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
