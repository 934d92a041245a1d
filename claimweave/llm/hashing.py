"""Vectorised 64-bit mixing and list columns as arrays, shared by the sketching operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def list_array(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int64()))


def flat_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row starts (with the end) of a list column; null lists count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    return column.flatten().to_numpy(zero_copy_only=False), starts
