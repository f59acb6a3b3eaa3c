import numpy as np
import pytest
from pyspark.sql import functions as F

from vecengine.operators import linalg


def frame(spark, a, b=None):
    rows = [(i, m.tolist(), None if b is None else b[i].tolist()) for i, m in enumerate(a)]
    kind = "array<double>" if b is None or b[0].ndim == 1 else "array<array<double>>"
    return spark.createDataFrame(rows, f"id long, a array<array<double>>, b {kind}")


def spd(n, k, seed=42):
    g = np.random.default_rng(seed).standard_normal((n, k, k))
    return g @ g.transpose(0, 2, 1) + 2 * np.eye(k)


def out(df, column):
    return np.array([r[0] for r in df.select("id", column.alias("x")).orderBy("id").select("x").collect()])


@pytest.mark.parametrize("k", [3, 16, 40, 90])
def test_solve_and_factors(spark, k):
    a = spd(10, k)
    b = np.random.default_rng(43).standard_normal((10, k))
    df = frame(spark, a, b)
    x = out(df, linalg.solve(F.col("a"), F.col("b")))
    assert np.abs(np.einsum("bij,bj->bi", a, x) - b).max() < 1e-6
    low = out(df, linalg.cholesky(F.col("a")))
    assert np.allclose(low @ low.transpose(0, 2, 1), a) and np.allclose(np.triu(low, 1), 0)
    both = df.withColumn("l", linalg.cholesky(F.col("a")))
    y = out(both, linalg.tril_solve(F.col("l"), F.col("b")))
    assert np.allclose(np.einsum("bij,bj->bi", low, y), b)
    z = out(both, linalg.triu_solve(F.col("l"), F.col("b")))
    assert np.allclose(np.einsum("bji,bj->bi", low, z), b)
    assert np.allclose(out(df, linalg.logdet_spd(F.col("a"))), np.linalg.slogdet(a)[1])


def test_several_right_sides_and_lu(spark):
    a = np.random.default_rng(1).standard_normal((6, 5, 5))
    b = np.random.default_rng(2).standard_normal((6, 5, 3))
    x = out(frame(spark, a, b), linalg.solve_lu(F.col("a"), F.col("b"), vector=False))
    assert np.allclose(a @ x, b)


def test_singular_gives_nan_and_zero_determinant(spark):
    a = np.array([[[1.0, 2], [2, 4]], [[2.0, 0], [0, 2]], [[0.0, 1], [1, 0]]])
    df = frame(spark, a, np.ones((3, 2)))
    x = out(df, linalg.solve_lu(F.col("a"), F.col("b")))
    assert np.isnan(x[0]).all() and np.allclose(x[1:], [[0.5, 0.5], [1, 1]])
    assert np.allclose(out(df, linalg.det(F.col("a"))), [0, 4, -1])
    s = df.select("id", linalg.slogdet(F.col("a")).alias("x")).orderBy("id").select("x.*").collect()
    assert (s[0].sign, s[0].logabsdet) == (0.0, float("-inf")) and s[2].sign == -1.0


@pytest.mark.parametrize("k", [1, 5, 12, 64])
def test_qr_is_householder_in_every_column(spark, k):
    a = np.random.default_rng(7).standard_normal((4, k, k))
    rows = frame(spark, a).select("id", linalg.qr(F.col("a")).alias("x")).orderBy("id").select("x.*").collect()
    q, r = np.array([x.q for x in rows]), np.array([x.r for x in rows])
    assert np.allclose(q @ r, a) and np.allclose(q @ q.transpose(0, 2, 1), np.eye(k)) and np.allclose(np.tril(r, -1), 0)
    assert np.allclose(np.linalg.det(q), (-1.0) ** k)  # k reflections


def test_mixed_shapes_keep_their_rows(spark):
    a = [np.eye(2) * 4, np.eye(3) * 9, np.eye(2)]
    got = frame(spark, a).select("id", linalg.det(F.col("a")).alias("d")).orderBy("id").collect()
    assert np.allclose([r.d for r in got], [16, 729, 1])


def test_not_positive_definite(spark):
    df = frame(spark, np.array([[[1.0, 2], [2, 1]]]))
    with pytest.raises(Exception, match="positive definite"):
        df.select(linalg.cholesky(F.col("a"))).collect()
    low = out(df, linalg.cholesky(F.col("a"), "clamp"))
    assert np.isfinite(low).all() and low[0, 1, 1] == pytest.approx(1e-6)


@pytest.mark.parametrize("rows", [[(0, None)], [(0, [[1.0, None]])], [(0, [[1.0], [1.0, 2.0]])]])
def test_null_and_ragged_raise(spark, rows):
    df = spark.createDataFrame(rows, "id long, a array<array<double>>")
    with pytest.raises(Exception, match="NULL|ragged"):
        df.select(linalg.det(F.col("a"))).collect()


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, a array<array<double>>")
    assert df.select(linalg.det(F.col("a")), linalg.cholesky(F.col("a"))).collect() == []
