"""k-means by Lloyd's iterations: centres go out, per-partition sums come back; points never move."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecengine.functions import blocks
from vecengine.operators import factor
from vecengine.plans import strategy


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T), 0.0)


def _merge(a: tuple, b: tuple) -> tuple:
    """Sums and counts add; of the farthest points the k farthest stay, ties by their coordinates."""
    far, d = np.concatenate((a[3], b[3])), np.concatenate((a[4], b[4]))
    order = np.lexsort((*far.T[::-1], -d))[: len(a[1])]
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], far[order], d[order]


def step(df: DataFrame, features_col: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(sums, counts, inertia, farthest points) of one assignment to centres; the lowest index wins ties."""
    k = len(centres)

    def first(column) -> tuple:
        x = blocks.vectors(column, centres.shape[1])
        d2 = squared_distances(x, centres)
        labels = np.argmin(d2, axis=1)
        least = ((x - centres[labels]) ** 2).sum(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, labels, x)
        order = np.lexsort((*x.T[::-1], -least))[:k]
        return sums, np.bincount(labels, minlength=k).astype(float), np.array(least.sum()), x[order], least[order]

    sums, counts, inertia, far, _ = factor._reduced(df, [features_col], first, _merge, alike=False)  # few rows give fewer farthest points; first checks the length of vectors
    return sums, counts, float(inertia), far


def lloyd_step(centres: np.ndarray, sums: np.ndarray, counts: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Means; the empty clusters take the farthest points in order."""
    new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    empty = np.flatnonzero(counts == 0)
    new[empty[: len(far)]] = far[: len(empty)]
    return new


@dataclass(frozen=True)
class KMeansModel:
    cluster_centers_: np.ndarray
    inertia_: float
    n_iter_: int

    def predict(self, df: DataFrame, features_col: str = "features", output_col: str = "label") -> DataFrame:
        centres = self.cluster_centers_

        def run(column: pa.Array) -> pa.Array:
            rows = strategy.batch_rows(len(centres))
            labels = [np.argmin(squared_distances(blocks.vectors(column.slice(i, rows), centres.shape[1]), centres), axis=1) for i in range(0, len(column), rows)]
            return pa.array(np.concatenate(labels) if labels else [], pa.int32())

        return df.withColumn(output_col, F.arrow_udf(run, "int")(F.col(features_col)))

    def transform(self, df: DataFrame, features_col: str = "features", output_col: str = "distances") -> DataFrame:
        """Euclidean distances to all centres."""
        centres = self.cluster_centers_
        return factor.mapped(df, features_col, output_col, lambda x: np.sqrt(squared_distances(x, centres)), scores=len(centres))


def nearest_centre(features: Column, centres: list[list[float]]) -> Column:
    """predict as an expression, for few centres."""
    from vecengine.functions import expr

    d2 = F.array(*[F.struct(expr.squared_distance(features, F.lit(c)).alias("d2"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return F.array_min(d2)["i"]


@dataclass(frozen=True)
class KMeans:
    """init: "k-means++", "random", or an array of centres. random_state None is 0."""

    n_clusters: int = 8
    init: str | np.ndarray = "k-means++"
    n_init: int = 3
    max_iter: int = 300
    tol: float = 1e-4
    random_state: int | None = 42

    def _sample(self, df: DataFrame, id_col: str, features_col: str, weights_from: np.ndarray | None, count: int, rng: np.random.Generator) -> np.ndarray:
        """count rows, with chance in proportion to their squared distance from the nearest of weights_from (all alike if None):
        the rows with the least exponential of that rate, drawn from a hash of their id, so one pass and no order of rows."""
        seed = int(rng.integers(1 << 62))
        u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        weight = F.lit(1.0)
        if weights_from is not None:
            def run(column: pa.Array) -> pa.Array:
                return pa.array(squared_distances(blocks.vectors(column), weights_from).min(axis=1) if len(column) else np.zeros(0))

            weight = F.arrow_udf(run, "double")(F.col(features_col))
        rows = df.select(F.col(id_col), F.col(features_col), weight.alias("w")).select(id_col, features_col, F.when(F.col("w") > 0, -F.log(u) / F.col("w")).otherwise(F.lit(float("inf"))).alias("e"))
        return np.array([r[1] for r in rows.orderBy("e", id_col).limit(count).collect()], float)

    def _start(self, df: DataFrame, id_col: str, features_col: str, n: int, rng: np.random.Generator) -> np.ndarray:
        if not isinstance(self.init, str):
            return np.array(self.init, float)
        if self.init == "random" or self.n_clusters >= n:
            return self._sample(df, id_col, features_col, None, self.n_clusters, rng)
        if self.init != "k-means++":
            raise ValueError(f"unknown init {self.init!r}")
        centres = self._sample(df, id_col, features_col, None, 1, rng)
        while len(centres) < self.n_clusters:
            tries = self._sample(df, id_col, features_col, centres, 2, rng)
            cost = factor.summed(df, [features_col], lambda c, t=tries, m=centres: tuple(np.array(squared_distances(blocks.vectors(c), np.vstack([m, x])).min(axis=1).sum()) for x in t))
            centres = np.vstack([centres, tries[int(np.argmin(cost))]])
        return centres

    def fit(self, df: DataFrame, id_col: str = "id", features_col: str = "features", y=None) -> KMeansModel:
        n, _ = strategy.shape(df, features_col)
        if self.n_clusters > n:
            raise ValueError(f"{self.n_clusters} clusters of {n} rows")
        df, best = df.select(id_col, features_col).persist(), None
        try:
            for run in range(self.n_init if isinstance(self.init, str) else 1):
                centres = self._start(df, id_col, features_col, n, np.random.default_rng((self.random_state or 0) + run))
                for it in range(1, self.max_iter + 1):  # noqa: B007
                    sums, counts, _, far = step(df, features_col, centres)
                    new = lloyd_step(centres, sums, counts, far)
                    shift = np.linalg.norm(new - centres) / max(np.linalg.norm(new), 1e-30)
                    centres = new
                    if shift < self.tol:
                        break
                inertia = step(df, features_col, centres)[2]
                if best is None or inertia < best.inertia_:
                    best = KMeansModel(centres, inertia, it)
        finally:
            df.unpersist()
        return best

    def fit_predict(self, df: DataFrame, id_col: str = "id", features_col: str = "features", output_col: str = "label") -> DataFrame:
        return self.fit(df, id_col, features_col).predict(df, features_col, output_col)
