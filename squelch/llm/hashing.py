"""Words of whole Arrow batches and their 64-bit hashes, vectorised over the text bytes.

A word's hash is a polynomial of random byte values modulo 2**64, taken from one running sum over
the buffer, and then mixed. Functions here work on one slice of a batch, half a megabyte of text
(or one longer document), so memory has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def byte_table(separators: bytes) -> bytes:
    """A translation that lower-cases A-Z and turns ``separators`` into blanks."""
    out = bytearray(range(256))
    for b in range(65, 91):
        out[b] = b + 32
    for b in separators:
        out[b] = 32
    return bytes(out)


#: Words are whatever is not ASCII white space.
SPACED = byte_table(bytes([32, *range(9, 14)]))
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, by in (("up", _BASE), ("down", _INVERSE)):
            full = np.full(n, by, np.uint64)
            full[0] = 1
            _POWERS[name] = np.multiply.accumulate(full)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Cut a string column into runs of rows: (first row, end row, bytes, offsets from 0). Nulls
    are empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, where, data = column.buffers()
    ends = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = memoryview(data) if data is not None else memoryview(b"")
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, bytes(data[ends[row] : ends[stop]]), ends[row : stop + 1] - ends[row]
        row = stop


class Words:
    """All words of one slice: ``start`` and ``end`` (bytes), ``doc`` (row in the slice), and
    ``first`` (word number where each row begins, with a closing entry).
    """

    def __init__(self, text: bytes, offsets: np.ndarray, translation: bytes):
        self.buffer = text.translate(translation)
        data = np.frombuffer(self.buffer, np.uint8)
        inside = data != 32
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._data = data

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        up, down = _powers(len(self._data) + 1)
        sums = np.zeros(len(self._data) + 1, np.uint64)
        np.cumsum(_VALUES[self._data] * up[: len(self._data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, one per start that has ``n`` words in the array."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        total = mix(total * np.uint64(0xD1342543DE82EF95) + words[i : len(words) - n + 1 + i] + np.uint64(n))
    return total
