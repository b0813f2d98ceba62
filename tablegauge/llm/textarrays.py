"""Words of Arrow text columns as numpy arrays: spans in the UTF-8 bytes and 64-bit hashes of any byte range.

A hash is a polynomial over the bytes of the range, modulo 2**64, divided by the power at its start, so that it
depends on nothing but the bytes.  All words of a batch are hashed in a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Space, and tab to carriage return.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
CHUNK_BYTES = 1 << 20

_is_blank = np.zeros(256, bool)
_is_blank[list(BLANKS)] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for at least n bytes; kept for the life of the worker."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            tables.append(np.multiply.accumulate(factors))
        if size > 8 * CHUNK_BYTES:
            return tables
        _powers[:] = tables
    return _powers


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection for each seed."""
    h = h ^ np.uint64((seed * _WORD_BASE) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """The bytes of some texts and where each one begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        powers, inverse = _power_tables(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[: len(self.data)], out=self._sums[1:])
        return mixed((self._sums[ends] - self._sums[starts]) * inverse[starts])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the maximal runs of bytes marked inside, never across two texts."""
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        after[-1:], after[:-1] = False, inside[1:]
        full = self.offsets[1:] > self.offsets[:-1]
        before[self.offsets[:-1][full]] = False
        after[self.offsets[1:][full] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of anything but blanks."""
        return self.runs(~_is_blank[self.data])


def grams(words: np.ndarray, owner: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and the position of each one's first word."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    last = len(words) - n + 1
    base = np.uint64((_WORD_BASE + 2 * seed) & 0xFFFFFFFFFFFFFFFF)
    h = words[:last].copy()
    for j in range(1, n):
        h *= base
        h += words[j: last + j]
    at = np.flatnonzero(owner[:last] == owner[n - 1:])
    return mixed(h[at], seed), at


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of about ``limit`` bytes of text (a longer text is a slice of its own), so that memory stays bounded."""
    for batch in batches:
        place = batch.schema.get_field_index(column)
        _, offsets = text_column(batch.column(place))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            part = batch.slice(first, last - first)
            yield part, Texts(*text_column(part.column(place)))
            first = last
