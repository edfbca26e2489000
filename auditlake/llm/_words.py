"""Vectorised words and 64-bit hashes over the bytes of an Arrow string column.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. All arrays are numpy; hashing runs over
blocks of about a megabyte, so that temporary memory doesn't follow the length of a text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 20
_powers: dict = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _BLOCK + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * _BLOCK:
            _powers[base] = have
    return have[:n]


def trim() -> None:
    """Give freed memory back to the system: a worker's memory then follows one step, not the largest ones so far."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def spans(data: np.ndarray, at: np.ndarray, stop: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the range of its words (rows + 1)."""
    inside = ~stop[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        after[-1] = False
        after[:-1] = inside[1:]
        first, last = at[:-1], at[1:] - 1
        full = first <= last
        before[first[full]] = False
        after[last[full]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial in the bytes, then :func:`mix`."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        block = data[low : ends[j - 1]]
        total = np.empty(len(block) + 1, np.uint64)
        total[0] = 0
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(block)), out=total[1:])
        out[i:j] = (total[ends[i:j] - low] - total[starts[i:j] - low]) * _power(_INVERSE, len(block) + 1)[starts[i:j] - low]
        i = j
    return mix(out)


def windows(h: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every ``size`` consecutive values of ``h``; the value depends on their order."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    out = np.empty(len(h) - size + 1, np.uint64)
    for low in range(0, len(out), _BLOCK):
        part = h[low : min(len(h), low + _BLOCK + size - 1)]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part * _power(base, len(part)), out=total[1:])
        n = len(part) - size + 1
        out[low : low + n] = (total[size:] - total[:n]) * _power(inverse, len(part))[:n]
    return mix(out)
