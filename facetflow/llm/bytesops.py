"""Vectorised kernels over the UTF-8 buffer of an Arrow string column.

All of them see a block of rows as one byte array plus row offsets, so the
Python cost is per block and not per word.  Blocks are cut at row ends and
bounded in bytes; a single longer text is a block of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C55)
_BASE_INV = _U(pow(0x9E3779B97F4A7C55, -1, 1 << 64))


def random_u64(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, (1 << 64) - 1, n, dtype=np.uint64, endpoint=True)


_BYTE_CODE = random_u64(256, 11)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges ``[i, j)`` of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def trim() -> None:
    """Give freed memory back, so that a reused worker does not carry it on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
#: Fixed value: separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Fixed value: separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
PUNCT = np.zeros(256, bool)
PUNCT[0x00:0x30] = PUNCT[0x3A:0x61] = PUNCT[0x7B:0x80] = True


def word_spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the row of each; words end at row ends."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~sep[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def stretches(data: np.ndarray, off: np.ndarray, sep: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """The whole of a block, or of a single longer row stretches that end at separators.

    A longer run without a separator is a stretch of its own.
    """
    lo, n = 0, len(data)
    if len(off) > 2 or n <= limit:
        yield 0, n
        return
    while lo < n:
        hi, size = n, limit
        while lo + size < n:
            at = np.flatnonzero(sep[data[lo : lo + size]])
            if len(at) and at[-1]:
                hi = lo + int(at[-1])
                break
            size *= 2
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Powers:
    """Powers of the polynomial's base, and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 1)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE, np.uint64)]))
                self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE_INV, np.uint64)]))
        return self.up, self.down


POWERS = Powers()


def prefix_hashes(data: np.ndarray, code: np.ndarray = _BYTE_CODE) -> np.ndarray:
    """``S`` with ``S[i]`` the polynomial of the first ``i`` bytes, modulo 2**64."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(code[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(pre: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the bytes stand."""
    _, down = POWERS.get(len(pre))
    with np.errstate(over="ignore"):
        return mix((pre[e] - pre[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words of a row and the row of each.

    A row of fewer words, but not none, gives its whole sequence as one.
    """
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    factor = random_u64(k, 23) | _U(1)
    with np.errstate(over="ignore"):
        full = max(len(words) - k + 1, 0)
        acc = np.zeros(full, np.uint64)
        for j in range(k):
            acc += words[j : j + full] * factor[j]
        ok = row[:full] == row[k - 1 : k - 1 + full] if full else np.zeros(0, bool)
        hashes, rows = mix(acc[ok]), row[:full][ok]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = count[short] > j
                extra[has] += words[first[short[has]] + j] * factor[j]
            extra = mix(extra + count[short].astype(np.uint64) * _U(0xA0761D6478BD642F))
            hashes = np.concatenate([hashes, extra])
            rows = np.concatenate([rows, short])
    return hashes, rows


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes row by row, and offsets (n_rows + 1)."""
    order = np.argsort(rows, kind="stable")
    hashes, count = hashes[order], np.bincount(rows, minlength=n_rows)
    bound = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero(count > 1):
        hashes[bound[i] : bound[i + 1]].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[bound[:-1][count > 0]] = True
    row = np.repeat(np.arange(n_rows), count)[keep]
    return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))])
