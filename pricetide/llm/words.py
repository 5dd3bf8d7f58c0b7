"""Words of whole Arrow batches as NumPy arrays: byte classes, spans and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(members: bytes) -> np.ndarray:
    """Table of 256 flags, true for the bytes given."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Between words of the contracts: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = byte_class(b" \t\n\x0b\x0c\r")


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, so that every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of some consecutive texts: start and end byte, text number and hash of each; first word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, blanks: np.ndarray, lower: bool = True):
        self.bounds = bounds  # of the texts in data, one more than texts
        self.data = LOWER[data] if lower else data
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = ~blanks[data]
        before = np.concatenate(([False], inside[:-1]))
        cut = np.zeros(len(data) + 1, dtype=bool)  # a text's first byte starts a word even behind another text's word
        cut[bounds] = True
        self.starts = np.flatnonzero(inside & (~before | cut))
        self.ends = np.flatnonzero(before & (~inside | cut))
        self.text = np.searchsorted(bounds, self.starts, side="right") - 1
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        size = 1 << max(20, int(len(self.data)).bit_length())
        up, down = _powers(size)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and bounds of runs of texts of about `size` bytes each; a longer text stays whole."""
    data, offsets = texts_of(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def windows(hashes: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Hash of the words at the given offsets from every start; windows over the end are left out."""
    n = max(len(hashes) - offsets[-1], 0)
    total = np.zeros(n, dtype=np.uint64)
    for k in offsets:
        total = (total + hashes[k : k + n]) * _BASE
    return mix(total)


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column over one flat array."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
