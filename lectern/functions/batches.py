"""Arrow batches bounded in bytes, as rows hold whole texts; and what a Python worker, which outlives its tasks, keeps of them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` bytes of a string column, a longer text alone, as work on a slice takes
    many times its size. Spark itself ends a batch at ``spark.sql.execution.arrow.maxBytesPerBatch``."""
    for b in batches:
        block = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy().astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        yield from (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i)
    pa.default_memory_pool().release_unused()  # a worker outlives its task


#: What the tasks of one operator leave in a worker for the next ones of their kind, by name; one operator's at a time.
_KEPT: dict[Any, Any] = {}


def kept(name: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gave to an earlier task of this worker under the same name; what other operators left goes."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def give_back() -> None:
    """Returns what a task has freed to the system, as its Python worker lives on beside those of other stages."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches in a worker that first drops what other operators left, and gives memory back once it is done.

    All workers of an executor take turns, so without it each of them holds, for as long as the executor lives, the most
    that any stage has taken.
    """

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _KEPT.clear()
        yield from run(batches)
        give_back()

    return whole
