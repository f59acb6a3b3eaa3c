import numpy as np
import pyarrow as pa
import pytest

from vecengine.operators import cluster, nndescent, sparse
from vecengine.operators import neighbors as N
from vecengine.sources.tables import from_numpy


def brute(x, k):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    return [sorted((v, j) for j, v in enumerate(row) if np.isfinite(v))[:k] for row in d]


def edges(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.src, []).append((r.rank, r.dist, r.dst))
    return {k: [(d, i) for _, d, i in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("k", [1, 8, 40])
def test_exact_knn(spark, k):
    x = np.random.default_rng(42).standard_normal((90, 3))
    df, want = from_numpy(spark, x), brute(x, k)
    for found in (edges(N.knn(df, k)), edges(N.knn_points(df, k, leaf_size=8))):
        assert all([i for _, i in found[s]] == [j for _, j in want[s]] and np.allclose([d for d, _ in found[s]], [d for d, _ in want[s]]) for s in range(90))


@pytest.mark.parametrize("d", [2, 5, 10])
def test_walks_are_exact(spark, d):
    """By the tree on each worker and by joins, with points that coincide and with a k beyond a leaf."""
    rng = np.random.default_rng(d)
    x = np.vstack([rng.standard_normal((160, d)), np.ones((30, d)), rng.standard_normal((10, d)) * 100]).astype(np.float32).astype(float)
    df = from_numpy(spark, x)
    want = edges(N.knn(df, 12))
    assert edges(N.knn_points(df, 12, leaf_size=6)) == want
    got = edges(N.knn_points(df, 12, leaf_size=6, limit=0))
    assert {s: [i for _, i in v] for s, v in got.items()} == {s: [i for _, i in v] for s, v in want.items()}


def test_leaves_are_cut_at_the_highest_bit():
    codes = np.array([0, 1, 2, 3, 8, 9, 10, 11, 12, 13, 14, 15, 64, 64, 64, 64, 64, 64, 64, 64, 64, 64])
    starts = N.leaf_starts(codes, 6)
    assert starts.tolist() == [0, 4, 8, 12, 18]  # 3 to 6 points each; the last run is all alike and cut at 6
    assert N.leaf_starts(codes[:4], 6).tolist() == [0]
    assert N.bit_lengths(np.array([0, 1, 2, (1 << 32) - 1, 1 << 32, (1 << 62) + 1, (1 << 63) - 1])).tolist() == [0, 1, 2, 32, 33, 63, 63]


def test_blocks_on_executors_and_many_ties(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((150, 3)), 0)
    df, queries = from_numpy(spark, x), from_numpy(spark, np.round(rng.standard_normal((20, 3)), 1))
    for q, b, k, own in ((df, df, 7, True), (queries, df, 5, False)):
        want = edges(N.top_k(N.candidates(q, b, k, own), k))
        assert edges(N.top_k(N.candidates(q, b, k, own, limit=0), k)) == want
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert all([i for _, i in row] == [j for _, j in sorted((v, j) for j, v in enumerate(d[s]) if j != s)[:7]] for s, row in edges(N.knn(df, 7)).items())


def test_a_periodic_box_is_refused(spark):
    df = from_numpy(spark, np.zeros((3, 2)))
    for f in (N.knn, N.knn_points):
        with pytest.raises(ValueError):
            f(df, 1, boxsize=1.0)


def test_duplicates_ties_and_few_points(spark):
    x = np.array([[0.0, 0], [0, 0], [1, 0], [-1, 0], [0, 1]])
    df = from_numpy(spark, x)
    assert edges(N.knn(df, 3))[0] == [(0.0, 1), (1.0, 2), (1.0, 3)]
    assert edges(N.knn_points(df, 9, leaf_size=2)) == edges(N.knn(df, 9))
    wide = {r.src: r for r in N.wide(N.knn(df, 6), 6).collect()}
    assert wide[0].dst[-2:] == [-1, -1] and wide[0].dist[-1] == float("inf")


def test_morton_keeps_order_of_each_axis():
    x = np.array([[-2.0, 1], [-1, 1], [0, 1], [0.5, 1], [3, 1]])
    assert (np.diff(N.morton_block(x)) > 0).all()
    assert (np.diff(N.sortable_bits(np.array([-5.0, -1, -0.1, 0.0, 0.2, 7])).astype(np.int64)) > 0).all()
    with pytest.raises(ValueError):
        N.morton_block(np.zeros((2, 1)))


def test_radius_join_is_strict_and_has_no_cap(spark):
    x = np.vstack([np.zeros((300, 2)), [[1.0, 0]]])
    got = N.radius_join(from_numpy(spark, x), 1.0)
    assert got.count() == 300 * 300 + 1


def test_tree_counts(spark):
    x = np.random.default_rng(1).standard_normal((100, 2))
    t = N.tree(N.with_leaves(from_numpy(spark, x), 8), 4).collect()
    top = max(r.level for r in t)
    assert all(sum(r.npart for r in t if r.level == v) == 100 for v in range(top + 1))
    root = next(r for r in t if r.level == top)
    assert np.allclose(root.centre, x.mean(0)) and np.allclose(root.low, x.min(0)) and np.allclose(root.high, x.max(0))


@pytest.mark.parametrize("kind", [nndescent.NNDescent, nndescent.NNDescentBatched])
@pytest.mark.parametrize("n,d,k,least", [(200, 8, 10, 0.95), (1000, 50, 15, 0.8)])
def test_nndescent_recall(spark, kind, n, d, k, least):
    x = np.random.default_rng(42).standard_normal((n, d))
    df = from_numpy(spark, x)
    g = kind(k=k, seed=1).build(df).collect()
    exact = {(s, j) for s, row in enumerate(brute(x, k)) for _, j in row}
    assert len(g) == n * k and all(r.src != r.dst for r in g) and len({(r.src, r.dst) for r in g} & exact) / len(exact) > least
    assert all(r.dist == pytest.approx(((x[r.src] - x[r.dst]) ** 2).sum()) for r in g)
    assert [(r.src, r.rank) for r in g] == [(i, j) for i in range(n) for j in range(1, k + 1)]
    with pytest.raises(ValueError):
        kind(k=n).build(df)


def test_nndescent_by_joins_seeds_and_early_stop(spark):
    x = np.random.default_rng(4).standard_normal((120, 6))
    df = from_numpy(spark, x)
    exact = {(s, j) for s, row in enumerate(brute(x, 6)) for _, j in row}
    share = lambda g: len({(r.src, r.dst) for r in g} & exact) / len(exact)
    joined = nndescent.NNDescent(k=6, seed=2, max_candidates=12, n_iters=6).build(df, limit=0).collect()
    assert share(joined) > 0.85 and all(r.dist == pytest.approx(((x[r.src] - x[r.dst]) ** 2).sum()) for r in joined)
    one, two = (nndescent.NNDescent(k=6, seed=2).build(df.repartition(p)).collect() for p in (1, 3))
    assert one == two
    assert share(nndescent.NNDescent(k=6, seed=2, n_iters=1).build(df).collect()) < share(one)
    assert share(nndescent.NNDescent(k=6, seed=2, delta=1.0).build(df).collect()) < share(one)  # it stops after the first round


def blobs(n, k, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.uniform(-10, 10, (k, 4))
    return c, c[np.arange(n) % k] + 0.3 * rng.standard_normal((n, 4))


def test_kmeans_finds_blobs(spark):
    c, x = blobs(300, 4)
    df = from_numpy(spark, x)
    m = cluster.KMeans(4).fit(df)
    d = np.linalg.norm(m.cluster_centers_[:, None] - c[None], axis=2)
    assert (d.min(axis=0) < 1).all() and len(set(d.argmin(axis=0))) == 4
    labels = {r.id: r.label for r in m.predict(df).collect()}
    dist = {r.id: r.distances for r in m.transform(df).collect()}
    assert all(np.argmin(dist[i]) == labels[i] for i in labels)
    inertia = sum(min(np.array(v) ** 2) for v in dist.values())
    assert m.inertia_ == pytest.approx(inertia)
    with pytest.raises(ValueError):
        cluster.KMeans(301).fit(df)


def test_random_starts_and_more_of_them(spark):
    _, x = blobs(200, 6, 3)
    df = from_numpy(spark, x)
    few, more = (cluster.KMeans(6, n_init=n, init="random", max_iter=20).fit(df) for n in (1, 4))
    assert more.inertia_ <= few.inertia_ + 1e-9 and few.cluster_centers_.shape == (6, 4)
    assert all((np.abs(x - c).sum(1) < 20).any() for c in few.cluster_centers_)


def test_empty_clusters_take_the_farthest_points(spark):
    x = np.array([[0.0], [0.1], [10.0]])
    m = cluster.KMeans(2, init=np.array([[0.0], [100.0]]), max_iter=5).fit(from_numpy(spark, np.hstack([x, x])).selectExpr("id", "array(features[0]) features"))
    assert sorted(m.cluster_centers_[:, 0].round(2).tolist()) == [0.05, 10.0]


def test_sparse_products(spark):
    rng = np.random.default_rng(10)
    a = rng.standard_normal((30, 50)) * (rng.random((30, 50)) < 0.05)
    a[5:9] = 0
    b = rng.standard_normal((50, 6))
    rows = from_numpy(spark, a)
    coo = sparse.from_dense(rows, "id", "features")
    dense = spark.createDataFrame([(j, r.tolist()) for j, r in enumerate(b)], "j long, row array<double>")
    c = sparse.spmm(coo, dense, rows.selectExpr("id i")).orderBy("i").collect()
    assert np.allclose([r.c for r in c], a @ b)
    ptr = sparse.row_pointers(coo, rows, "id").orderBy("i").collect()
    assert [r.stop for r in ptr] == np.cumsum((a != 0).sum(1)).tolist()


def test_blocks_give_k_rows_for_each_query(spark):
    """However many blocks of the base there are: what is shuffled doesn't grow with their number."""
    df = from_numpy(spark, np.random.default_rng(8).standard_normal((150, 4))).repartition(5)
    assert N.candidates(df, df, 3, True, limit=0).count() == 450


@pytest.mark.parametrize("shift,scale", [(0.0, 1.0), (1e6, 1.0), (0.0, 1e25)])
def test_nearest_over_blocks_is_exact(shift, scale):
    """Near and far from the origin, with ties, and where single precision has no room."""
    x = np.round(np.random.default_rng(9).standard_normal((300, 3)), 1) * scale + shift
    ids, k = np.random.default_rng(1).permutation(300), 6
    found = N.Nearest(x[:40], ids[:40], k, False)
    for i in range(0, 300, 70):
        found.see(ids[i : i + 70], x[i : i + 70])
    d = ((x[:40, None] - x[None]) ** 2).sum(2)
    d[np.arange(40), np.arange(40)] = np.inf
    assert [r.tolist() for r in found.dst] == [ids[np.lexsort((ids, row))[:k]].tolist() for row in d]


@pytest.mark.parametrize("limit", [0, 1 << 27])
def test_blocks_are_bounded(spark, limit):
    """A block's scores don't grow with the table."""
    from vecengine.operators import pairs

    df = from_numpy(spark, np.random.default_rng(8).standard_normal((2300, 1))).coalesce(1)
    size = lambda own, x, ids, y: pa.RecordBatch.from_pydict({"n": [len(own) * len(ids)]})
    sizes = [r.n for r in pairs.met(df, df, size, "n long", "id", "features", limit).collect()]
    assert sum(sizes) == 2300**2 and max(sizes) <= pairs.TILE * pairs.OTHERS


def test_box_pairs_are_measured_in_blocks(spark):
    """A row for each pair, without a join whose side is sent to all."""
    low = np.random.default_rng(4).standard_normal((30, 3))
    high = low + np.random.default_rng(5).random((30, 3))
    b = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(low, high, strict=True))], "leaf long, low array<double>, high array<double>")
    pairs = N.box_pairs(b, b)
    gap = np.maximum(np.maximum(low[None] - high[:, None], low[:, None] - high[None]), 0)
    got = {(r.a, r.b): r.d2 for r in pairs.collect()}
    assert len(got) == 900 and all(np.isclose(got[i, j], (gap[i, j] ** 2).sum()) for i, j in got)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("d,many", [(2, 1), (3, 700)])
def test_radius_join_in_runs_equals_brute_force(spark, d, many):
    """Sparse cells, and cells of more points than a run holds; nothing is sent to all, and a point with a NULL has no partners."""
    x = np.vstack([np.random.default_rng(6).uniform(-4, 4, (200, d)), np.full((many, d), 0.2)])
    df = from_numpy(spark, x)
    nulls = spark.createDataFrame([(5000, [None] * d), (5001, None)], df.schema)
    near = N.radius_join(df.unionByName(nulls), 0.9, include_self=False)
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {(i, j): d2[i, j] for i, j in zip(*map(np.ndarray.tolist, np.nonzero(d2 < 0.81)), strict=True) if i != j}
    got = {(r.src, r.dst): r.d2 for r in near.collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[p], want[p]) for p in got)


def test_a_walk_shuffles_leaves_and_not_pairs(spark):
    """Exact whether the boxes go to the workers or the walk is joins; no window over pairs of points."""
    x = np.random.default_rng(12).uniform(0, 9, (400, 2)).round(1)
    df = from_numpy(spark, x)
    want = edges(N.knn(df, 4))
    found = N.knn_points(df, 4, leaf_size=10, limit=0)
    assert edges(found) == want and "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert edges(N._walked(df.select("id", df.features.alias("f")), 4, 10, 3, 2, limit=0)) == want


def test_nndescent_sends_4_bytes_and_a_bit_for_each_edge(spark, monkeypatch):
    """What a round sends to the driver has no distances, and the graph isn't sent back from there."""
    from pyspark.sql.classic.dataframe import DataFrame

    sent, collect = [], DataFrame.collect

    def watched(self):
        rows = collect(self)
        sent.append(sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(DataFrame, "collect", watched)
    g = nndescent.NNDescent(k=8, seed=1).build(from_numpy(spark, np.random.default_rng(2).standard_normal((256, 4))))
    assert 0 < max(sent) <= 256 * 8 * 4 + 256 * 8 // 8 + 64
    assert "MapInArrow" in g._jdf.queryExecution().executedPlan().toString()
