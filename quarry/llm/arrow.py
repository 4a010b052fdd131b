"""Small helpers for Arrow batches inside ``mapInArrow``."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``limit`` bytes at most; a larger value is a slice alone."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    a = 0
    while a < batch.num_rows:
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(a, b - a)
        a = b
    release()


def release() -> None:
    """Give freed memory back to the system. Several Python workers share an executor and idle ones stay for a while;
    what each of them keeps adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
