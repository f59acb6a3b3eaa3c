"""Batched dense linear algebra: one matrix per row, in array<array<double>> columns.

Each function returns a Column. Rows of a batch that share a shape are solved together in NumPy; rows never move. A null or ragged
matrix raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecengine.functions import blocks

MATRIX, VECTOR = "array<array<double>>", "array<double>"
_MATRIX, _VECTOR = pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64())
TINY = 1e-12  # fixed value: the least pivot of a clamped factorisation


def _square(a: np.ndarray) -> np.ndarray:
    if a.shape[1] != a.shape[2]:
        raise ValueError(f"a matrix of shape {a.shape[1:]} isn't square")
    return a


def cholesky_blocks(a: np.ndarray, on_error: str = "raise") -> np.ndarray:
    """Lower factors; on_error "clamp" replaces pivots below TINY, so that any matrix has a finite factor."""
    _square(a)
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        if on_error != "clamp":
            raise ValueError("a matrix isn't positive definite") from None
    low = np.zeros_like(a)
    for j in range(a.shape[1]):
        rest = a[:, j:, j] - np.einsum("bik,bk->bi", low[:, j:, :j], low[:, j, :j])
        pivot = np.sqrt(np.maximum(rest[:, 0], TINY))
        low[:, j, j] = pivot
        low[:, j + 1 :, j] = rest[:, 1:] / pivot[:, None]
    return low


def forward(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L x = b, reading the lower triangle only; b is (rows, k, m)."""
    x = np.zeros_like(b)
    for i in range(low.shape[1]):
        x[:, i] = (b[:, i] - np.einsum("bj,bjm->bm", low[:, i, :i], x[:, :i])) / low[:, i, i, None]
    return x


def backward(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L^T x = b, given the lower L."""
    x = np.zeros_like(b)
    for i in range(low.shape[1] - 1, -1, -1):
        x[:, i] = (b[:, i] - np.einsum("bj,bjm->bm", low[:, i + 1 :, i], x[:, i + 1 :])) / low[:, i, i, None]
    return x


def lu_solve_blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Any square system; NaN where a matrix is singular."""
    _square(a)
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        out = np.full_like(b, np.nan)
        for i in range(len(a)):
            try:
                out[i] = np.linalg.solve(a[i], b[i])
            except np.linalg.LinAlgError:
                pass
        return out


def householder_blocks(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q and R with R_jj = -sign(x_jj) |x_j|, sign(0) = 1, for every column, the last one too."""
    _square(a)
    r, n = a.astype(float).copy(), a.shape[1]
    q = np.broadcast_to(np.eye(n), a.shape).copy()
    for j in range(n):
        x = r[:, j:, j]
        norm = np.linalg.norm(x, axis=1)
        v = x.copy()
        v[:, 0] += np.where(x[:, 0] >= 0, 1.0, -1.0) * norm
        size = np.einsum("bi,bi->b", v, v)
        scale = np.divide(2.0, size, out=np.zeros_like(size), where=size > 0)
        r[:, j:, :] -= scale[:, None, None] * v[:, :, None] * np.einsum("bi,bim->bm", v, r[:, j:, :])[:, None, :]
        q[:, :, j:] -= scale[:, None, None] * np.einsum("bmi,bi->bm", q[:, :, j:], v)[:, :, None] * v[:, None, :]
        r[:, j + 1 :, j] = 0.0
    return q, r


def _one(fn, kind: pa.DataType, ddl: str, pack):
    def run(a: pa.Array) -> pa.Array:
        return blocks.gathered(len(a), [(which, fn(m)) for which, m in blocks.matrices(a)], pack, kind)

    return F.arrow_udf(run, ddl)


def _two(fn, vector: bool):
    """fn(a, b) for matrices a and right-hand sides b, which are vectors or matrices; the result is as b."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        right: dict[int, np.ndarray] = {}
        if vector:
            if b.null_count:
                raise ValueError("a right-hand side is NULL")
            right = {i: np.array(x, float)[:, None] for i, x in enumerate(b.to_pylist())}
        else:
            for which, m in blocks.matrices(b):
                right.update(zip(which.tolist(), m, strict=True))
        parts = []
        for which, m in blocks.matrices(a):
            by: dict[tuple, list[int]] = {}
            for at, i in enumerate(which.tolist()):
                if right[i].shape[0] != m.shape[1]:
                    raise ValueError("a right-hand side doesn't fit its matrix")
                by.setdefault(right[i].shape, []).append(at)
            for at in by.values():
                x = fn(m[at], np.stack([right[i] for i in which[at].tolist()]))
                parts.append((which[at], x[:, :, 0] if vector else x))
        return blocks.gathered(len(a), parts, blocks.as_vectors if vector else blocks.as_matrices, _VECTOR if vector else _MATRIX)

    return F.arrow_udf(run, VECTOR if vector else MATRIX)


def cholesky(a: Column, on_error: str = "raise") -> Column:
    return _one(lambda m: cholesky_blocks(m, on_error), _MATRIX, MATRIX, blocks.as_matrices)(a)


def solve(a: Column, b: Column, vector: bool = True, on_error: str = "raise") -> Column:
    """Symmetric positive definite systems. b is a vector for each matrix, or with vector=False a matrix of right-hand sides."""

    def run(m: np.ndarray, r: np.ndarray) -> np.ndarray:
        low = cholesky_blocks(m, on_error)
        return backward(low, forward(low, r))

    return _two(run, vector)(a, b)


solve_cholesky = solve


def solve_lu(a: Column, b: Column, vector: bool = True) -> Column:
    return _two(lu_solve_blocks, vector)(a, b)


def tril_solve(low: Column, b: Column, vector: bool = True) -> Column:
    return _two(forward, vector)(low, b)


def triu_solve(low: Column, b: Column, vector: bool = True) -> Column:
    """Solves L^T x = b, given the lower factor L."""
    return _two(backward, vector)(low, b)


def qr(a: Column) -> Column:
    """struct<q, r>."""

    def run(a: pa.Array) -> pa.Array:
        parts = [(which, householder_blocks(m)) for which, m in blocks.matrices(a)]
        both = [blocks.gathered(len(a), [(which, x[k]) for which, x in parts], blocks.as_matrices, _MATRIX) for k in (0, 1)]
        return pa.StructArray.from_arrays(both, names=["q", "r"])

    return F.arrow_udf(run, f"struct<q: {MATRIX}, r: {MATRIX}>")(a)


def det(a: Column) -> Column:
    def fn(m: np.ndarray) -> np.ndarray:
        sign, log = np.linalg.slogdet(_square(m))
        return sign * np.exp(log)

    return _one(fn, pa.float64(), "double", pa.array)(a)


def slogdet(a: Column) -> Column:
    """struct<sign, logabsdet>; 0 and -infinity for a singular matrix."""

    def run(a: pa.Array) -> pa.Array:
        parts = [(which, np.linalg.slogdet(_square(m))) for which, m in blocks.matrices(a)]
        both = [blocks.gathered(len(a), [(which, np.asarray(x[k])) for which, x in parts], pa.array, pa.float64()) for k in (0, 1)]
        return pa.StructArray.from_arrays(both, names=["sign", "logabsdet"])

    return F.arrow_udf(run, "struct<sign: double, logabsdet: double>")(a)


def logdet_spd(a: Column, on_error: str = "raise") -> Column:
    def fn(m: np.ndarray) -> np.ndarray:
        return 2 * np.log(np.diagonal(cholesky_blocks(m, on_error), axis1=1, axis2=2)).sum(axis=1)

    return _one(fn, pa.float64(), "double", pa.array)(a)
