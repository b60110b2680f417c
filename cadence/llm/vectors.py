"""Vector columns as numpy matrices, for the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(usable, values): rows of a list column as doubles, shorter ones filled up with zeros.

    Not usable: null, and any null or non-finite component. Their values are zeros.
    """
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    # a null list may still own values in its buffer: flatten() leaves those out
    values = column.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    good = np.isfinite(out).all(axis=1) & np.asarray(column.is_valid())
    out[~good] = 0
    return good, out


def widen(values: np.ndarray, width: int) -> np.ndarray:
    """Columns filled up with zeros to ``width``."""
    if values.shape[1] >= width:
        return values
    return np.pad(values, ((0, 0), (0, width - values.shape[1])))
