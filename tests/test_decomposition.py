import numpy as np
import pytest
from pyspark.sql import functions as F

from vecengine.operators import decomposition as D
from vecengine.operators import kernels as K
from vecengine.operators import projection as P
from vecengine.sources.tables import from_numpy


def back(df, column="z"):
    return np.array([r[0] for r in df.orderBy("id").select(column).collect()])


def low_rank(n, m, rank, seed=0):
    rng = np.random.default_rng(seed)
    u, v = np.linalg.qr(rng.standard_normal((n, rank)))[0], np.linalg.qr(rng.standard_normal((m, rank)))[0]
    return (u * (10 * np.exp(-0.3 * np.arange(rank)))) @ v.T


@pytest.mark.parametrize("solver", ["gram", "sketch"])
def test_svd_matches_exact(spark, solver):
    x = low_rank(200, 30, 12)
    s, v, _, _ = D.randomized_svd(from_numpy(spark, x), 6, solver=solver)
    exact = np.linalg.svd(x, full_matrices=False)[1][:6]
    assert np.abs(s / exact - 1).max() < 0.01 and np.allclose(v @ v.T, np.eye(6), atol=1e-6)
    assert (v[np.arange(6), np.abs(v).argmax(1)] > 0).all()
    u = back(D.left_vectors(from_numpy(spark, x), s, v), "u")
    assert np.allclose(u.T @ u, np.eye(6), atol=1e-5)


def test_batched_svd(spark):
    xs = [low_rank(30, 8, 4, s) for s in (1, 2)]
    df = spark.createDataFrame([(b, i, r.tolist()) for b, x in enumerate(xs) for i, r in enumerate(x)], "batch_id int, row_id int, features array<double>")
    got = {r.batch_id: r.s for r in D.batched_svd(df, 3).collect()}
    assert all(np.allclose(got[b], np.linalg.svd(x)[1][:3]) for b, x in enumerate(xs))


@pytest.mark.parametrize("solver", ["gram", "sketch"])
def test_batched_svd_by_either_way(spark, solver):
    xs = [low_rank(n, 10, 6, s) for n, s in ((40, 1), (25, 2), (7, 3))]
    df = spark.createDataFrame([(f"b{b}", i, r.tolist()) for b, x in enumerate(xs) for i, r in enumerate(x)], "batch_id string, row_id int, features array<double>").repartition(3)
    for r in D.batched_svd(df, 4, solver=solver).collect():
        u, s, vt = np.linalg.svd(xs[int(r.batch_id[1])], full_matrices=False)
        vt = vt[:4] * np.sign(vt[np.arange(4), np.abs(vt[:4]).argmax(1)])[:, None]
        assert np.allclose(r.s, s[:4]) and np.allclose(r.vt, vt, atol=1e-6)


def test_batched_pca_is_that_of_each_batch(spark):
    xs = [np.random.default_rng(s).standard_normal((n, 6)) * np.arange(1, 7) + s for n, s in ((50, 1), (9, 2))]
    rows = [(b, i, r.tolist()) for b, x in enumerate(xs) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (7, 0, None), (None, 0, xs[0][0].tolist())], "batch_id int, row_id int, features array<double>").repartition(3)
    models = D.batched_pca(df.where("features IS NOT NULL"), 3)
    got = {r.batch_id: r for r in models.collect()}
    assert set(got) == {0, 1}
    for b, x in enumerate(xs):
        one = D.PCA(3).fit(from_numpy(spark, x))
        for name in ("mean", "components", "singular_values", "explained_variance", "explained_variance_ratio"):
            assert np.allclose(getattr(got[b], name), getattr(one, name + "_")), name
        assert got[b].n == len(x)
        z = D.batched_transform(df, models).where(f"batch_id = {b}").orderBy("row_id").collect()
        assert np.allclose([r.z for r in z], (x - one.mean_) @ one.components_.T)
    assert [r.z for r in D.batched_transform(df, models).where("batch_id = 7 OR batch_id IS NULL").collect()] == [None, None]


@pytest.mark.parametrize("n,d,k", [(60, 20, 5), (300, 64, 10), (50, 120, 8)])
def test_svd_and_pca_at_other_shapes(spark, n, d, k):
    """Against the full decomposition, taller and wider than long; one pass and the sketch agree."""
    x = low_rank(n, d, 15, n)
    df = from_numpy(spark, x)
    exact = np.linalg.svd(x, full_matrices=False)
    s, v, _, rows = D.randomized_svd(df, k)
    assert rows == n and np.allclose(s, exact[1][:k], rtol=1e-6) and np.allclose(np.abs((v * exact[2][:k]).sum(1)), 1, atol=1e-5)
    centred = np.linalg.svd(x - x.mean(0), compute_uv=False)
    for solver in ("gram", "sketch"):
        m = D.PCA(k, solver=solver).fit(df)
        assert np.allclose(m.singular_values_, centred[:k], rtol=1e-3) and m.explained_variance_ratio_.sum() <= 1 + 1e-9
        assert np.allclose(m.explained_variance_ratio_, centred[:k] ** 2 / (centred**2).sum(), rtol=1e-3)


def test_reduction_over_two_levels(spark, monkeypatch):
    """The same sums whether the driver merges the partitions' states or tasks do first."""
    from vecengine.operators import factor

    df = from_numpy(spark, np.random.default_rng(5).standard_normal((300, 6))).repartition(9)
    one = factor.moments(df, "features")
    monkeypatch.setattr(factor, "SMALL_BYTES", 0)
    two = factor.moments(df, "features")
    assert one[0] == two[0] == 300 and np.allclose(one[1], two[1]) and np.allclose(one[2], two[2])


def test_dimensions_by_rule(spark):
    df = from_numpy(spark, np.random.default_rng(6).standard_normal((30, 5)))
    k = P.johnson_lindenstrauss_min_dim(30, 0.5)
    assert P.GaussianRandomProjection("auto", eps=0.5).fit(df).components_.shape == (k, 5)
    assert P.SparseRandomProjection("auto", eps=0.5).fit(df).components_.shape == (k, 5)


def test_pca_round_trip_and_whitening(spark):
    x = np.random.default_rng(3).standard_normal((200, 8)) + 5
    df = from_numpy(spark, x)
    m = D.PCA(8, whiten=True).fit(df)
    z = m.transform(df)
    assert np.allclose(back(z).var(axis=0, ddof=1), 1) and np.allclose(m.mean_, x.mean(0))
    assert np.allclose(back(m.inverse_transform(z.select("id", "z")), "features"), x)
    assert m.explained_variance_ratio_.sum() == pytest.approx(1)
    t = D.TruncatedSVD(3).fit(df)
    assert np.allclose(back(t.transform(df)), x @ t.components_.T)


@pytest.mark.parametrize("name", ["linear", "rbf", "poly", "sigmoid"])
def test_kernels(spark, name):
    x, y = np.random.default_rng(0).standard_normal((2, 20, 5))
    got = K.pairwise_kernel(from_numpy(spark, x), from_numpy(spark, y), kernel=name)
    k = np.zeros((20, 20))
    for r in got.collect():
        k[r.i, r.j] = r.k
    assert np.allclose(k, K.kernel_block(x, y, name, None))
    with pytest.raises(ValueError):
        K.pairwise_kernel(from_numpy(spark, x), kernel="other")


def test_nystroem_and_kernel_pca(spark):
    x = np.random.default_rng(1).standard_normal((60, 4))
    df, k = from_numpy(spark, x), K.kernel_block(x, x, "rbf", 0.1)
    errors = []
    for m in (10, 30, 60):
        z = back(K.Nystroem(m, gamma=0.1).fit_transform(df))
        errors.append(np.linalg.norm(z @ z.T - k) / np.linalg.norm(k))
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-6
    z = back(K.KernelPCA(60, gamma=0.1).fit_transform(df))
    c = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    assert np.allclose(z @ z.T, c, atol=1e-6)


def test_projections(spark):
    x = np.random.default_rng(0).standard_normal((50, 400))
    df = from_numpy(spark, x)
    z = back(P.GaussianRandomProjection(200).fit_transform(df))
    d = lambda a: np.linalg.norm(a[:, None] - a[None], axis=2)[np.triu_indices(50, 1)]
    assert (np.abs(d(z) / d(x) - 1) < 0.3).mean() > 0.9
    m = P.SparseRandomProjection(20).fit(df)
    assert len(np.unique(m.components_.round(9))) == 3
    joined = np.array([r.c for r in m.transform_sparse(df).orderBy("i").collect()])
    assert np.allclose(joined, back(m.transform(df)))
    assert P.johnson_lindenstrauss_min_dim(1000, 0.1) == 5920
    for bad in ({"density": 0.0}, {"density": 1.5}):
        with pytest.raises(ValueError):
            P.SparseRandomProjection(5, **bad).fit(df)
    with pytest.raises(Exception, match="elements"):
        m.transform(from_numpy(spark, x[:, :9])).collect()


def test_ensemble(spark):
    x = np.random.default_rng(5).standard_normal((40, 30))
    df = from_numpy(spark, x).withColumn("y", F.col("id").cast("double"))
    m = P.EnsembleRandomProjection(4).fit(df)
    assert m.n_members_ == 5 and m.member_kinds == ["pca", "sparse", "sparse", "gaussian", "gaussian"]
    z = m.transform(df).collect()
    pca = {r.id: r.z for r in z if r.member == 0}
    assert np.allclose([pca[i] for i in range(40)], back(m.members_[0].transform(df)))
    got = P.ensemble_mean_predict(m, lambda a, y, b: np.full(len(b), y.mean()), df, df).collect()
    assert len(got) == 40 and all(r.prediction == pytest.approx(19.5) for r in got)
    with pytest.raises(ValueError):
        P.EnsembleRandomProjection(4, n_pca=0, n_sparse=0, n_gaussian=0)


@pytest.mark.parametrize("rows", [[(0, None)], [(0, [1.0]), (1, [1.0, 2.0])], []])
def test_bad_input_raises(spark, rows):
    df = spark.createDataFrame(rows, "id long, features array<double>")
    with pytest.raises(ValueError):
        D.PCA(1).fit(df)


@pytest.mark.parametrize("parts", [1, 2])
@pytest.mark.parametrize("fit", [lambda df: D.PCA(1).fit(df), lambda df: D.TruncatedSVD(1).fit(df), lambda df: D.batched_pca(df.withColumn("batch_id", F.lit(1)), 1).collect()])
def test_ragged_vectors_raise_wherever_they_lie(spark, fit, parts):
    """A vector of one element isn't stretched to the others' length, in one partition or two."""
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, features array<double>").repartitionByRange(parts, "id")
    with pytest.raises(Exception, match="elements|one length"):
        fit(df)


@pytest.mark.parametrize("limit", [0, 1 << 27])
@pytest.mark.parametrize("name", ["linear", "rbf", "poly", "sigmoid"])
def test_centred_kernel_and_sums_of_rows(spark, name, limit):
    x = np.random.default_rng(2).standard_normal((70, 4)) + 0.5
    df, k = from_numpy(spark, x).repartition(3), K.kernel_block(x, x, name, 0.2)
    c = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    got = np.full((70, 70), np.nan)
    for r in K.centred_kernel(df, kernel=name, gamma=0.2, limit=limit).collect():
        got[r.i, r.j] = r.k
    assert np.allclose(got, c)
    if name != "sigmoid":  # which can have negative eigenvalues, that the features leave out
        assert np.allclose(back(K.Nystroem(None, name, 0.2).row_sums(df, limit=limit), "s"), k.sum(1))
        assert np.allclose(back(K.KernelPCA(None, name, 0.2).squared_norms(df, limit=limit), "s"), np.diag(c))
    for some in (K.Nystroem(20, name, 0.2), K.KernelPCA(5, name, 0.2)):
        z = back(some.fit_transform(df))
        sums = back(some.row_sums(df) if isinstance(some, K.Nystroem) else some.squared_norms(df), "s")
        assert np.allclose(sums, z @ z.sum(0) if isinstance(some, K.Nystroem) else (z * z).sum(1))


def test_full_rank_at_more_rows_than_a_driver_decomposes(spark):
    """5,000 rows: beyond what fit takes."""
    x = np.random.default_rng(3).standard_normal((5000, 2))
    df, k = from_numpy(spark, x), K.kernel_block(x, x, "rbf", 1.0)
    assert np.allclose(back(K.KernelPCA(None, gamma=1.0).squared_norms(df), "s"), np.diag(k) - 2 * k.mean(0) + k.mean())
    assert np.allclose(back(K.Nystroem(None, gamma=1.0).row_sums(df), "s"), k.sum(0))


def test_rounding_is_half_away_from_zero():
    from vecengine.operators import pairs

    got = pairs.rounded(np.array([0.25, -0.25, 0.24999, -1e-9, 3.0, np.inf]), 1)
    assert got.tolist() == [0.3, -0.3, 0.2, 0.0, 3.0, np.inf] and not np.signbit(got[3])
