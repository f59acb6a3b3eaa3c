"""Arrow lists as NumPy blocks and back. A null or ragged vector or matrix raises ValueError."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def _flat(values: pa.Array) -> np.ndarray:
    if values.null_count:
        raise ValueError("a vector has a NULL element")
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _whole(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("a vector or matrix is NULL")
    return column


def vectors(column, length: int | None = None) -> np.ndarray:
    """(rows, d) from list<float>."""
    column = _whole(column)
    n = len(column)
    flat = _flat(column.flatten())
    sizes = np.diff(column.offsets.to_numpy())[:n] if n else np.zeros(0, int)
    d = length if length is not None else int(sizes[0]) if n else 0
    if n and (sizes != d).any():
        raise ValueError(f"vectors must have {d} elements; there are {sorted(set(sizes.tolist()))[:5]}")
    return flat.reshape(n, d)


def matrices(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, (rows, r, c)) for each shape in list<list<float>>."""
    column = _whole(column)
    n = len(column)
    if not n:
        return []
    inner = column.flatten()
    if inner.null_count:
        raise ValueError("a matrix has a NULL row")
    rows = np.diff(column.offsets.to_numpy())
    widths = np.diff(inner.offsets.to_numpy())
    first = np.concatenate(([0], np.cumsum(rows)))
    cols = np.array([widths[a] if b > a else 0 for a, b in zip(first[:-1], first[1:], strict=True)])
    if (widths != np.repeat(cols, rows)).any():
        raise ValueError("a matrix is ragged")
    flat, sizes = _flat(inner.flatten()), rows * cols
    at, out = np.concatenate(([0], np.cumsum(sizes))), []
    shapes = np.stack([rows, cols], axis=1)
    for r, c in np.unique(shapes, axis=0):
        which = np.flatnonzero((rows == r) & (cols == c))
        block = flat.reshape(n, r, c) if len(which) == n else np.stack([flat[at[i] : at[i + 1]].reshape(r, c) for i in which])
        out.append((which, block))
    return out


def as_vectors(block: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    n, d = block.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(block).reshape(-1), kind))


def as_matrices(block: np.ndarray) -> pa.Array:
    n, r, c = block.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(n * r + 1) * c, pa.int32()), pa.array(np.ascontiguousarray(block).reshape(-1)))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * r, pa.int32()), inner)


def gathered(n: int, parts: list[tuple[np.ndarray, np.ndarray]], pack: Callable[[np.ndarray], pa.Array], kind: pa.DataType) -> pa.Array:
    """Results for shapes put back in the order of the rows."""
    if not parts:
        return pa.array([], kind)
    whole = pa.concat_arrays([pack(block).cast(kind) for _, block in parts])
    order = np.argsort(np.concatenate([which for which, _ in parts]))
    return whole if len(parts) == 1 else whole.take(pa.array(order))
