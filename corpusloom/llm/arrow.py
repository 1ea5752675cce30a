"""Small helpers around Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def ragged_binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values``, ``counts`` long, as one binary column."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * np.int32(values.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
