"""Byte-level word scanning over Arrow string columns, shared by the operators.

Texts stay in their Arrow buffer; words are found with a 256-entry byte table
and hashed with a prefix-summed polynomial, so no Python object is made per
word.  A multi-byte UTF-8 character never contains an ASCII byte, hence a byte
class that treats every byte >= 0x80 alike is exact for the ASCII-defined word
classes of the operators.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the scratch arrays to about 100 MB.
CHUNK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _table(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


#: `[^\x20\x09-\x0D]+`
NON_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def trim() -> None:
    """Gives freed memory back to the system: Python workers stay alive between stages, and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_pow_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _pow_cache:
        if size > CHUNK_BYTES * 2:  # one very long text; not kept
            return _powers(_BASE, size), _powers(_BASE_INV, size)
        _pow_cache[size] = (_powers(_BASE, size), _powers(_BASE_INV, size))
    return _pow_cache[size]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each values[start:end]; equal spans have equal hashes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _pow_tables(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _GOLDEN)


class Words(NamedTuple):
    """Words of a run of texts. Word i is data[starts[i]:ends[i]]; text d has words ptr[d]:ptr[d + 1]."""

    data: np.ndarray
    offsets: np.ndarray  #: text d is data[offsets[d]:offsets[d + 1]]
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of true values; none crosses one of ``offsets``."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, last = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(inside))]
    begins[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(last) + 1


def scan(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> Words:
    if lower:
        data = _LOWER[data]
    starts, ends = runs(table[data], offsets)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(column: pa.Array, table: np.ndarray, lower: bool = True, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, past-last row, words) over row runs of about ``limit`` bytes; a longer text is a run of its own."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table, lower)
        i = j
    trim()
