"""Vectors of Arrow lists as rows of numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def finite(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a list array: which rows are neither null nor hold null or non-finite components, and of those the lengths and the components as doubles."""
    array = array.cast(pa.large_list(pa.float64()))
    off = array.offsets.to_numpy()
    values = array.flatten().to_numpy(zero_copy_only=False) if array.null_count == 0 else array.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False)
    length = np.diff(off)
    row = np.repeat(np.arange(len(array)), length)
    bad = np.bincount(row, weights=~np.isfinite(values), minlength=len(array)) > 0
    good = ~bad & array.is_valid().to_numpy(zero_copy_only=False)
    return good, length[good], values[good[row]]


def padded(length: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Rows of `length` components each as a matrix of `width` columns; what a row lacks is zero."""
    if (length == width).all():
        return values.reshape(len(length), width)
    out = np.zeros((len(length), width), values.dtype)
    first = np.cumsum(length) - length
    out[np.repeat(np.arange(len(length)), length), np.arange(len(values)) - np.repeat(first, length)] = values
    return out


def from_binary(array: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    """A binary array of components of `kind` as a matrix of doubles."""
    array = array.cast(pa.large_binary())
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    values = np.frombuffer(raw.tobytes(), kind).astype(np.float64)
    return padded(np.diff(off) // kind.itemsize, values, width)


def lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list array."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel(), kind))
