"""Byte-level views of Arrow text columns and polynomial span hashes.

The operators work on whole Arrow batches with numpy: one batch is cut into
slices of bounded bytes (a longer text is a slice of its own), so a worker's
memory follows the slice, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: Odd, so every power has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def byte_slices(column: pa.Array, max_bytes: int = SLICE_BYTES
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, bytes, offsets)``; a null text is empty.

    ``offsets`` has one entry more than there are rows and starts at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    blob = column.fill_null("").cast(pa.large_binary())
    n = len(blob)
    if n == 0:
        return
    _, offs, data = blob.buffers()
    offsets = np.frombuffer(offs, np.int64)[blob.offset:blob.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def lowered_words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The runs of ``inside`` bytes within each text, A-Z lower-cased, and where they start.

    ``inside`` must be cut at ASCII bytes only, so a run is valid text.
    """
    lowered = raw + np.uint8(32) * ((raw >= 0x41) & (raw <= 0x5A))
    change = np.ones(len(raw) + 1, bool)
    change[1:-1] = inside[1:] != inside[:-1]
    change[offsets] = True
    starts = np.flatnonzero(change[:-1] & inside)
    ends = np.flatnonzero(change[1:] & inside) + 1
    cuts = pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32))
    data = pa.py_buffer(np.ascontiguousarray(lowered[inside]))
    return pa.StringArray.from_buffers(len(starts), cuts, data).dictionary_encode(), starts


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = BASE):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = np.ones(1, np.uint64)
        self._down = np.ones(1, np.uint64)

    @staticmethod
    def _grow(table: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(table) < n:
            step = np.uint64(pow(base, len(table), 1 << 64))
            table = np.concatenate([table, table * step])
        return table

    def up(self, n: int) -> np.ndarray:
        self._up = self._grow(self._up, self.base, n)
        return self._up[:n]

    def down(self, n: int) -> np.ndarray:
        self._down = self._grow(self._down, self.inverse, n)
        return self._down[:n]


class PrefixHash:
    """Hashes of any span of ``values`` from one prefix sum.

    ``span(s, e)`` depends only on the values in ``[s, e)``. Equal hashes of
    different spans are possible; callers verify.
    """

    def __init__(self, values: np.ndarray, powers: Powers):
        n = len(values)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers.up(n), out=self._sums[1:])
        self._down = powers.down(n + 1)

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sums[ends] - self._sums[starts]) * self._down[starts]

    def windows(self, length: int) -> np.ndarray:
        """The hash of every span of ``length`` values, by start."""
        n = len(self._sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self._sums[length:] - self._sums[:n]) * self._down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash (the low bits of polynomial sums are weak)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
