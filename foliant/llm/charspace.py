"""Whole-batch code point arrays.

Arrow string columns are turned into one flat ``uint32`` array of code points plus row offsets with one
decode call per batch, and back with one encode call; nothing here loops over rows. All operators of this
subpackage that work on characters in Python use these helpers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of UTF-8 handled at once; bounds the size of the temporary arrays. A single longer text is handled alone.
SLICE_BYTES = 1 << 20


def flat(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (a null becomes the empty string)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    return array.fill_null("")


def byte_offsets(array: pa.Array) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]


def slices(array: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``most`` bytes, or one row where that is longer."""
    off, i, n = byte_offsets(array), 0, len(array)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def codepoints(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows in a row, offsets of the rows in code points) of an array made by flat()."""
    off = byte_offsets(array)
    data = array.buffers()[2]
    raw = data.slice(int(off[0]), int(off[-1] - off[0])).to_pybytes() if data is not None and off[-1] > off[0] else b""
    cps = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=heads[1:])
    return cps, heads[off - off[0]]


def strings(cps: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of codepoints()."""
    raw = cps.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000), out=ends[1:])
    buffers = [None, pa.py_buffer(ends[offsets].astype(np.int64)), pa.py_buffer(raw)]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, buffers[1], buffers[2])


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of every code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of flags over the ranges [starts, ends), by one prefix sum."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]
