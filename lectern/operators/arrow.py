"""Vectors between Arrow batches and numpy, and the first rows of groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column as (rows x dim doubles, mask of rows that are NULL); NULL rows hold zeros."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    if not missing.all():
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[~missing] = values.reshape(-1, dim)
    return out, missing


def first_per_group(groups: np.ndarray, keys: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Positions of the `k` least (key, tie) entries of each group, group by group in order."""
    order = np.lexsort((ties, keys, groups))
    ordered = groups[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, int)
    rank = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return order[rank < k]
