"""Random projections and ensembles of projections."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecengine.functions import blocks
from vecengine.operators import factor, sparse
from vecengine.operators.decomposition import PCA, PCAModel
from vecengine.plans import strategy


def johnson_lindenstrauss_min_dim(n_samples: int, eps: float = 0.1) -> int:
    if not 0 < eps < 1 or n_samples <= 0:
        raise ValueError("eps must lie between 0 and 1, and n_samples be above 0")
    return int(4 * math.log(n_samples) / (eps**2 / 2 - eps**3 / 3))


@dataclass(frozen=True)
class ProjectionModel:
    """components_ is (k, d)."""

    components_: np.ndarray
    kind: str
    store_sparse: bool = False

    def transform(self, df: DataFrame, features_col: str = "features", output_col: str = "z") -> DataFrame:
        r, d = self.components_, self.components_.shape[1]

        def fn(x: np.ndarray) -> np.ndarray:
            if x.shape[1] != d:
                raise ValueError(f"vectors must have {d} elements, not {x.shape[1]}")
            return x @ r.T

        return factor.mapped(df, features_col, output_col, fn)

    def transform_sparse(self, df: DataFrame, id_col: str = "id", features_col: str = "features") -> DataFrame:
        """(i, c): the same product as a join of stored elements with the projection's stored rows."""
        spark, r = df.sparkSession, self.components_
        table = spark.createDataFrame([(j, r[:, j].tolist()) for j in range(r.shape[1])], "j long, row array<double>")
        return sparse.spmm(sparse.from_dense(df, id_col, features_col), table, df.select(F.col(id_col).alias("i")))


@dataclass(frozen=True)
class GaussianRandomProjection:
    n_components: int | str = "auto"
    eps: float = 0.1
    random_state: int | None = 42

    def fit(self, df: DataFrame, features_col: str = "features", y=None) -> ProjectionModel:
        n, d = strategy.shape(df, features_col)
        k = johnson_lindenstrauss_min_dim(n, self.eps) if self.n_components == "auto" else int(self.n_components)
        r = np.random.default_rng(self.random_state).standard_normal((k, d)) / math.sqrt(k)
        return ProjectionModel(r, "gaussian")

    def fit_transform(self, df: DataFrame, features_col: str = "features", output_col: str = "z") -> DataFrame:
        return self.fit(df, features_col).transform(df, features_col, output_col)


@dataclass(frozen=True)
class SparseRandomProjection:
    n_components: int | str = "auto"
    density: float | str = "auto"
    eps: float = 0.1
    store_sparse: bool | str = "auto"
    random_state: int | None = 42

    def fit(self, df: DataFrame, features_col: str = "features", y=None) -> ProjectionModel:
        n, d = strategy.shape(df, features_col)
        k = johnson_lindenstrauss_min_dim(n, self.eps) if self.n_components == "auto" else int(self.n_components)
        density = 1 / math.sqrt(d) if self.density == "auto" else float(self.density)
        if not 0 < density <= 1:
            raise ValueError("density must be above 0 and at most 1")
        rng = np.random.default_rng(self.random_state)
        mask = rng.random((k, d)) < density if density < 1 else np.ones((k, d), bool)  # the mask is drawn before the signs
        signs = np.where(rng.random((k, d)) < 0.5, 1.0, -1.0)
        return ProjectionModel(mask * signs * math.sqrt(1 / (density * k)), "sparse", self.store_sparse is True)

    def fit_transform(self, df: DataFrame, features_col: str = "features", output_col: str = "z") -> DataFrame:
        return self.fit(df, features_col).transform(df, features_col, output_col)


@dataclass(frozen=True)
class EnsembleModel:
    members_: list[PCAModel | ProjectionModel]

    @property
    def n_members_(self) -> int:
        return len(self.members_)

    @property
    def member_kinds(self) -> list[str]:
        return ["pca" if isinstance(m, PCAModel) else m.kind for m in self.members_]

    def transform(self, df: DataFrame, id_col: str = "id", features_col: str = "features") -> DataFrame:
        """(member, id, z): all members in one product over one scan."""
        maps = [(m.components_.T / (m._scale() if isinstance(m, PCAModel) else 1.0), m.mean_ if isinstance(m, PCAModel) else None) for m in self.members_]
        wide = np.concatenate([w for w, _ in maps], axis=1)
        shift = np.concatenate([mean @ w if mean is not None else np.zeros(w.shape[1]) for w, mean in maps])
        cuts = np.cumsum([w.shape[1] for w, _ in maps])[:-1]
        kind = df.schema[id_col].dataType.simpleString()

        def run(batches):
            for batch in batches:
                z = blocks.vectors(batch.column(1)) @ wide - shift
                for member, part in enumerate(np.split(z, cuts, axis=1)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), member, np.int32)), batch.column(0), blocks.as_vectors(part)], names=["member", "id", "z"])

        return df.select(id_col, features_col).mapInArrow(run, f"member int, id {kind}, z array<double>")


@dataclass(frozen=True)
class EnsembleRandomProjection:
    n_components: int = 128
    n_pca: int = 1
    n_sparse: int = 2
    n_gaussian: int = 2
    density: float | str = "auto"
    random_state: int | None = 42
    pca_kwargs: dict = field(default_factory=dict)
    sparse_kwargs: dict = field(default_factory=dict)
    gaussian_kwargs: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.n_pca + self.n_sparse + self.n_gaussian <= 0:
            raise ValueError("the ensemble has no member")

    def fit(self, df: DataFrame, features_col: str = "features", y=None) -> EnsembleModel:
        base = self.random_state or 0
        members: list = []
        if self.n_pca:
            members += [PCA(self.n_components, random_state=base, **self.pca_kwargs).fit(df, features_col)] * self.n_pca  # equal seeds: one fit
        members += [SparseRandomProjection(self.n_components, density=self.density, random_state=base + 1 + i, **self.sparse_kwargs).fit(df, features_col) for i in range(self.n_sparse)]
        members += [GaussianRandomProjection(self.n_components, random_state=base + 1 + self.n_sparse + i, **self.gaussian_kwargs).fit(df, features_col) for i in range(self.n_gaussian)]
        return EnsembleModel(members)


def ensemble_mean_predict(ensemble: EnsembleModel, fit_predict: Callable, train: DataFrame, test: DataFrame, id_col: str = "id", features_col: str = "features", target_col: str = "y") -> DataFrame:
    """(id, prediction): fit_predict(Z_train, y_train, Z_test) for each member in a task of its own, then the mean by id.

    A member's projected rows are one group, as the callable wants them whole: n x n_components must fit a task.
    """
    z_train = ensemble.transform(train, id_col, features_col).join(train.select(F.col(id_col).alias("id"), F.col(target_col).alias("y")), "id").withColumn("test", F.lit(False))
    z_test = ensemble.transform(test, id_col, features_col).select("id", "member", "z", F.lit(None).cast("double").alias("y"), F.lit(True).alias("test"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        test = table.column("test").to_numpy(zero_copy_only=False)
        z = blocks.vectors(table.column("z"))
        y = table.column("y").to_numpy(zero_copy_only=False)
        out = np.asarray(fit_predict(z[~test], y[~test].astype(float), z[test]), float)
        return pa.table({"id": table.column("id").filter(pa.array(test)), "prediction": out})

    kind = test.schema[id_col].dataType.simpleString()
    each = z_train.select("id", "member", "z", "y", "test").unionByName(z_test).groupBy("member").applyInArrow(lambda t: run(t), f"id {kind}, prediction double")
    return each.groupBy("id").agg(F.avg("prediction").alias("prediction"))
