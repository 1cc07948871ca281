"""Vectors of whole numbers from arrays of floating-point numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Largest size of a component after scaling: sums of 64 squared differences then fit 63 bits.
LARGEST = 1 << 27


def finite_rows(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows without a null or non-finite component: their places, sizes, and ``floor(scale * x)`` of all.

    A row that is null itself is left out as well. Components beyond ``LARGEST`` are an error, as
    their squares would not fit a long.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(sizes)
    good = (bad[ends] == bad[ends - sizes]) & column.is_valid().to_numpy(zero_copy_only=False)
    whole = np.floor(scale * values[np.repeat(good, sizes)])
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a vector component is larger than {LARGEST / scale}")
    return np.flatnonzero(good), sizes[good], whole.astype(np.int64)


def as_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    data = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * (data.itemsize * data.shape[1])
    return pa.Array.from_buffers(
        pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def as_matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Back from the bytes of rows of equal length."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1) if parts else np.zeros((0, 0), kind)
