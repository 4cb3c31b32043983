"""Reading a column of vectors in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, shorter ones filled with zeros, and which are whole: not null, nothing in them null or not finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0)), np.zeros(0, bool)
    size = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    out = np.zeros((n, int(size.max(initial=0))))
    rows = np.repeat(np.arange(n), size)
    ends = np.cumsum(size)
    out[rows, np.arange(len(flat)) - np.repeat(ends - size, size)] = flat
    whole = np.asarray(column.is_valid()) & np.isfinite(out).all(1)
    return out, whole
