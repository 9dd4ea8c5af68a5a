"""Binary Arrow columns as numpy bytes, without a Python object per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def binary_bytes(column: pa.BinaryArray) -> np.ndarray:
    """The bytes of all rows end to end; the column holds no NULL."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8)
    ends = np.frombuffer(offsets, np.int32)
    # A copy: a slice's first byte need not lie where numbers of eight bytes may start.
    return np.frombuffer(data, np.uint8)[ends[column.offset] : ends[column.offset + len(column)]].copy()


def as_binary(values: np.ndarray, rows: int) -> pa.BinaryArray:
    """A binary column of rows of equally many values, the other way round."""
    data = np.ascontiguousarray(values)
    ends = np.arange(rows + 1, dtype=np.int32) * np.int32(data.nbytes // max(1, rows))
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
