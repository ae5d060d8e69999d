"""Blocks of whole texts inside Arrow batches, and a growing table of per-unit results for Python workers."""

from __future__ import annotations

import ctypes
import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19


def trimmed(run: Callable) -> Callable:
    """``run`` for mapInArrow; at a task's end the worker, which waits for the next one, gives freed memory back to the system."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def row_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for runs of rows of about ``limit`` bytes; a longer text is a block of its own. Null becomes ''."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, [x or "" for x in column.slice(at, stop - at).to_pylist()]
        at = stop


class _Index(dict):
    """unit -> row; a new unit gets the next row and waits in ``pending``."""

    def __init__(self) -> None:
        self.pending: list = []

    def __missing__(self, unit):
        row = self[unit] = len(self)
        self.pending.append(unit)
        return row


class UnitTable:
    """Result arrays of distinct text units, kept from call to call.

    ``compute(units)`` returns (flat, start, size): the results of all units, and where each one's are. Once the
    table holds more than ``limit`` units, it drops those that no later call than their first has met, and all of them if
    over half would stay. That bounds the worker's memory and changes no result; a dropped unit is computed anew.
    """

    def __init__(self, compute: Callable[[list], tuple[np.ndarray, np.ndarray, np.ndarray]], dtype, limit: int = 1_000_000) -> None:
        self.compute, self.dtype, self.limit = compute, np.dtype(dtype), limit
        self._reset()

    def _reset(self) -> None:
        self.index, self.used = _Index(), 0
        self.flat, self.start, self.size = np.empty(1 << 16, self.dtype), np.empty(1 << 12, np.int32), np.empty(1 << 12, np.uint16)
        self.again = np.zeros(1 << 12, bool)

    def _renew(self) -> None:
        kept = np.flatnonzero(self.again[: len(self.index)])
        if 2 * len(kept) > self.limit:
            return self._reset()
        names = list(itertools.compress(self.index, self.again.tolist()))
        flat, size = self.expand(kept.astype(np.int32))
        self._reset()
        self.index.update(zip(names, range(len(names)), strict=True))
        self._put(0, flat, np.cumsum(size) - size, size)

    def _put(self, before: int, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        if len(size) and int(size.max()) > 65535:
            self.size = self.size.astype(np.int32)
        stop = before + len(start)
        self.flat = _room(self.flat, self.used + len(flat))
        self.start, self.size, self.again = _room(self.start, stop), _room(self.size, stop), _room(self.again, stop)
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[before:stop] = start + self.used
        self.size[before:stop] = size
        self.again[before:stop] = False
        self.used += len(flat)

    def rows(self, units: list) -> np.ndarray:
        """Row of each unit; rows stay valid until the next call."""
        if len(self.index) > self.limit:
            self._renew()
        before = len(self.index)
        rows = np.fromiter(map(self.index.__getitem__, units), np.int32, len(units))
        if self.index.pending:
            flat, start, size = self.compute(self.index.pending)
            self.index.pending = []
            self._put(before, flat, start, size)
        self.again[rows[rows < before]] = True
        return rows

    def expand(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The concatenated results of ``rows`` and how many each row has."""
        size = self.size[rows].astype(np.int64)
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[rows] - (ends - size), size)
        return self.flat[at], size


def _room(held: np.ndarray, size: int) -> np.ndarray:
    if size <= len(held):
        return held
    grown = np.empty(size + len(held) // 2, held.dtype)
    grown[: len(held)] = held
    return grown
