"""Numpy kernels over the byte buffers of Arrow string columns.

Texts are handled as concatenated UTF-8 bytes, a few MB at a time, so that no
Python object is made per word, line or position and memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
GROUP_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of the shingle contracts: everything but space and 09-0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words of the benchmark contract: digits, lower-case letters and bytes over 7F.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
#: Values of bytes for a second, independent hash.
OTHER = mix(np.arange(1001, 1257, dtype=np.uint64) * GOLD)
_BASE = 0xD6E8FEB86659FD93
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    if len(_power[0]) < n:
        size = max(n, GROUP_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _power[k] = np.cumprod(p, dtype=np.uint64)
    return _power[0][:n], _power[1][:n]


class SpanHash:
    """Polynomial hashes of any spans of one buffer, from one prefix sum."""

    def __init__(self, buf: np.ndarray, values: np.ndarray = BYTE):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(values[buf] * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * GOLD)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def groups(buf: np.ndarray, offs: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, end row, bytes, offsets."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words; none crosses a row."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = is_word[buf]
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    inner = offs[(offs > 0) & (offs < len(buf))]
    before[inner] = False
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    after[inner - 1] = False
    start, end = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def first_of_row(row: np.ndarray, n: int) -> np.ndarray:
    """n+1 bounds of each row's entries in a sorted array of row numbers."""
    return np.searchsorted(row, np.arange(n + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
