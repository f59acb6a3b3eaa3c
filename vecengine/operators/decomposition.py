"""Singular value decomposition and principal components over tables of vectors.

Up to ``strategy.GRAM_FEATURES`` features one pass forms the Gram matrix and the driver takes its eigenvectors: exact,
with no sketch. Beyond that a seeded sketch with re-orthogonalised power steps (CholeskyQR, twice) makes two passes a step. Models are small and immutable; transforms are maps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecengine.functions import blocks
from vecengine.operators import factor
from vecengine.plans import strategy

FLOOR = 1e-20  # fixed value: the least variance that is divided by


def _top(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(values)[::-1][:k]
    return np.sqrt(np.maximum(values[order], 0.0)), vectors[:, order].T


def _sketched(df: DataFrame, features_col: str, mean: np.ndarray, n: int, d: int, k: int, oversamples: int, n_iter: int, seed: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of the centred rows from a randomised range finder."""
    width = min(k + oversamples, n, d)
    w = np.random.default_rng(seed).standard_normal((d, width))
    for _ in range(n_iter + 1):
        for _ in range(2):  # CholeskyQR loses half the digits, so it is done twice
            (g,) = factor.summed(df, [features_col], lambda c, w=w: (lambda y: (y.T @ y,))((blocks.vectors(c) - mean) @ w))
            values, vectors = np.linalg.eigh((g + g.T) / 2)
            good = values > values.max() * 1e-14 if values.max() > 0 else values > 1
            if not good.any():
                return np.zeros(k), np.eye(d)[:k]
            w = w @ (vectors[:, good] / np.sqrt(values[good]))
        # Now (X - mean) w has orthonormal columns: Z = X^T Q, and its range goes on.
        (z,) = factor.summed(df, [features_col], lambda c, w=w: (lambda x: (x.T @ (x @ w),))(blocks.vectors(c) - mean))
        last, w = z, np.linalg.qr(z)[0]
    u, s, _ = np.linalg.svd(last, full_matrices=False)
    s, v = s[:k], u[:, :k].T
    return s, v


def _fitted(df: DataFrame, n_components: int, features_col: str, n_oversamples: int, n_iter: int, random_state: int | None, flip_signs: bool, centre: bool, solver: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, float]:
    """(singular values, right vectors as rows, mean, rows, sum of all squares of the centred rows). One pass where a Gram matrix is formed."""
    if solver == "gram" or (solver == "auto" and strategy.width(df, features_col) <= strategy.GRAM_FEATURES):
        n, mean, gram = factor.moments(df, features_col, centred=centre)
        s, v = _top(gram, min(n_components, n, len(gram)))
        total = float(np.trace(gram))
    else:
        n, d = strategy.shape(df, features_col)
        if not n:
            raise ValueError("there are no rows")
        mean = factor.summed(df, [features_col], lambda c: (blocks.vectors(c).sum(axis=0),))[0] / n if centre else np.zeros(d)
        s, v = _sketched(df, features_col, mean, n, d, min(n_components, n, d), n_oversamples, n_iter, random_state)
        total = float(factor.summed(df, [features_col], lambda c: (((blocks.vectors(c) - mean) ** 2).sum(),))[0])
    if flip_signs:
        v = v * factor.signed(v)[:, None]
    return s, v, mean, n, total


def randomized_svd(df: DataFrame, n_components: int, *, features_col: str = "features", n_oversamples: int = 10, n_iter: int = 4, random_state: int | None = 42, flip_signs: bool = True, centre: bool = False, solver: str = "auto") -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(singular values, right vectors as rows, mean, rows). solver: gram, sketch or auto."""
    return _fitted(df, n_components, features_col, n_oversamples, n_iter, random_state, flip_signs, centre, solver)[:4]


def left_vectors(df: DataFrame, s: np.ndarray, v: np.ndarray, features_col: str = "features", output_col: str = "u", mean: np.ndarray | float = 0.0) -> DataFrame:
    """The rows' left singular vectors: (X - mean) V / S, zero where S is."""
    scale = np.divide(1.0, s, out=np.zeros_like(s), where=s > 0)
    return factor.mapped(df, features_col, output_col, lambda x: ((x - mean) @ v.T) * scale)


def _range_finder(x: np.ndarray, k: int, oversamples: int, n_iter: int, seed: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a matrix from a randomised range finder, orthonormalised at each half step."""
    width = min(k + oversamples, *x.shape)
    q = np.linalg.qr(x @ np.random.default_rng(seed).standard_normal((x.shape[1], width)))[0]
    for _ in range(n_iter):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    _, s, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    return s[:k], vt[:k]


def batched_svd(df: DataFrame, n_components: int, *, batch_col: str = "batch_id", row_col: str = "row_id", features_col: str = "features", n_oversamples: int = 10, n_iter: int = 4, random_state: int | None = 42, solver: str = "auto") -> DataFrame:
    """(batch_id, s, vt) of each batch's matrix; every batch has the same random start.

    solver gram sums up each matrix's d x d products in the partitions, so that no task holds its rows; sketch (the randomised range finder, for
    wide rows) takes a matrix as one group, which must fit a task; auto decides by the features.
    """
    kind = df.schema[batch_col].dataType.simpleString()
    if solver == "gram" or (solver == "auto" and strategy.width(df, features_col) <= strategy.GRAM_FEATURES):

        def finish(n: int, mean: np.ndarray, gram: np.ndarray) -> dict:
            s, v = _top(gram, min(n_components, n, len(gram)))
            return {"s": blocks.as_vectors(s[None]), "vt": blocks.as_matrices((v * factor.signed(v)[:, None])[None])}

        return factor.moments_by(df, batch_col, features_col, finish, "s array<double>, vt array<array<double>>", centred=False)

    def run(table: pa.Table) -> pa.Table:
        s, vt = _range_finder(blocks.vectors(table.sort_by(row_col).column(features_col)), n_components, n_oversamples, n_iter, random_state)
        return pa.table({batch_col: table.column(batch_col)[:1], "s": blocks.as_vectors(s[None]), "vt": blocks.as_matrices((vt * factor.signed(vt)[:, None])[None])})

    return df.select(batch_col, row_col, features_col).groupBy(batch_col).applyInArrow(lambda t: run(t), f"{batch_col} {kind}, s array<double>, vt array<array<double>>")


def batched_pca(df: DataFrame, n_components: int, *, batch_col: str = "batch_id", features_col: str = "features") -> DataFrame:
    """(batch_id, n, mean, components, singular_values, explained_variance, explained_variance_ratio): one row for each batch, from sums in the partitions."""

    def finish(n: int, mean: np.ndarray, products: np.ndarray) -> dict:
        s, v = _top(products, min(n_components, n, len(mean)))
        variance = s**2 / max(n - 1, 1)
        ratio = variance / max(float(np.trace(products)) / max(n - 1, 1), FLOOR)
        rows = {"mean": mean, "singular_values": s, "explained_variance": variance, "explained_variance_ratio": ratio}
        return {"n": pa.array([n], pa.int64()), "components": blocks.as_matrices((v * factor.signed(v)[:, None])[None])} | {k: blocks.as_vectors(x[None]) for k, x in rows.items()}

    ddl = "n long, components array<array<double>>, mean array<double>, singular_values array<double>, explained_variance array<double>, explained_variance_ratio array<double>"
    return factor.moments_by(df, batch_col, features_col, finish, ddl)


def batched_transform(df: DataFrame, models: DataFrame, *, batch_col: str = "batch_id", features_col: str = "features", output_col: str = "z", whiten: bool = False, inverse: bool = False) -> DataFrame:
    """df with output_col: each row in the components of its batch's model, or with inverse back from them. Rows without a model get null."""

    def run(batch: pa.Array, x: pa.Array, mean: pa.Array, components: pa.Array, variance: pa.Array) -> pa.Array:
        keys, parts, places = batch.dictionary_encode().indices.to_numpy(zero_copy_only=False), [], []
        usable = np.array([a and b for a, b in zip(mean.is_valid().to_pylist(), x.is_valid().to_pylist(), strict=True)], bool)
        for key in np.unique(keys[usable]):
            at = np.flatnonzero(usable & (keys == key))
            first = pa.array(at[:1])
            m, v, e = blocks.vectors(mean.take(first))[0], blocks.matrices(components.take(first))[0][1][0], blocks.vectors(variance.take(first))[0]
            scale = np.sqrt(np.maximum(e, FLOOR)) if whiten else 1.0
            block = blocks.vectors(x.take(pa.array(at)))
            parts.append(blocks.as_vectors((block * scale) @ v + m if inverse else ((block - m) @ v.T) / scale))
            places.append(at)
        if not parts:
            return pa.nulls(len(x), pa.list_(pa.float64()))
        place = np.full(len(x), -1)
        place[np.concatenate(places)] = np.arange(sum(map(len, places)))
        return pa.concat_arrays(parts).take(pa.array(place, mask=place < 0))

    rows = df.join(models.select(batch_col, "mean", "components", "explained_variance"), batch_col, "left")
    return rows.withColumn(output_col, F.arrow_udf(run, "array<double>")(batch_col, features_col, "mean", "components", "explained_variance")).drop("mean", "components", "explained_variance")


@dataclass(frozen=True)
class TruncatedSVDModel:
    components_: np.ndarray
    singular_values_: np.ndarray

    def transform(self, df: DataFrame, features_col: str = "features", output_col: str = "z") -> DataFrame:
        v = self.components_
        return factor.mapped(df, features_col, output_col, lambda x: x @ v.T)


@dataclass(frozen=True)
class TruncatedSVD:
    n_components: int = 2
    n_oversamples: int = 10
    n_iter: int = 4
    random_state: int | None = 42

    def fit(self, df: DataFrame, features_col: str = "features", y=None) -> TruncatedSVDModel:
        s, v, _, _ = randomized_svd(df, self.n_components, features_col=features_col, n_oversamples=self.n_oversamples, n_iter=self.n_iter, random_state=self.random_state)
        return TruncatedSVDModel(v, s)

    def fit_transform(self, df: DataFrame, features_col: str = "features", output_col: str = "z") -> DataFrame:
        return self.fit(df, features_col).transform(df, features_col, output_col)


@dataclass(frozen=True)
class PCAModel:
    mean_: np.ndarray
    components_: np.ndarray
    singular_values_: np.ndarray
    explained_variance_: np.ndarray
    explained_variance_ratio_: np.ndarray
    n_samples_: int
    whiten: bool = False

    def _scale(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.explained_variance_, FLOOR)) if self.whiten else np.ones(len(self.components_))

    def transform(self, df: DataFrame, features_col: str = "features", output_col: str = "z") -> DataFrame:
        v, mean, scale = self.components_, self.mean_, self._scale()
        return factor.mapped(df, features_col, output_col, lambda x: ((x - mean) @ v.T) / scale)

    def inverse_transform(self, df: DataFrame, z_col: str = "z", output_col: str = "features") -> DataFrame:
        v, mean, scale = self.components_, self.mean_, self._scale()
        return factor.mapped(df, z_col, output_col, lambda z: (z * scale) @ v + mean)


@dataclass(frozen=True)
class PCA:
    n_components: int
    n_oversamples: int = 10
    n_iter: int = 4
    whiten: bool = False
    random_state: int | None = 42
    solver: str = "auto"

    def fit(self, df: DataFrame, features_col: str = "features", y=None) -> PCAModel:
        s, v, mean, n, squares = _fitted(df, self.n_components, features_col, self.n_oversamples, self.n_iter, self.random_state, True, True, self.solver)
        variance = s**2 / max(n - 1, 1)
        return PCAModel(mean, v, s, variance, variance / max(squares / max(n - 1, 1), FLOOR), n, self.whiten)

    def fit_transform(self, df: DataFrame, features_col: str = "features", output_col: str = "z") -> DataFrame:
        return self.fit(df, features_col).transform(df, features_col, output_col)
