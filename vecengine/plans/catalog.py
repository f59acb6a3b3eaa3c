"""All registered queries of the vector operators and the SQL that they are held against.

Every query runs over its whole tables. Stochastic methods have no SQL: tests hold them against thresholds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecengine.functions import expr
from vecengine.operators import arrays, cluster, decomposition, kernels, linalg, neighbors, nndescent, projection, sparse
from vecengine.plans.ranges import ranked
from vecengine.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def near(c: Column | str, digits: int = 4) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def long(df: DataFrame, id_col: str, vector: str, digits: int = 4) -> DataFrame:
    """(id, j, x) of a vector column."""
    return df.select(id_col, F.posexplode(vector).alias("j", "x")).select(id_col, F.col("j").cast("long").alias("j"), near("x", digits).alias("x"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return tables.vectors(tables.table(spark, d, "embeddings"), "vec_id", "embedding")


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """The mean embedding of each label."""
    e = tables.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("j", "x")).groupBy("label", "j").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("features")).select(F.col("label").cast("long").alias("id"), "features")


SQL_E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
SQL_C = SQL_E + """, cj AS (SELECT label AS id, j, avg(v[j]) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS j FROM e) GROUP BY ALL),
c AS (SELECT CAST(id AS BIGINT) AS id, list(x ORDER BY j) AS v FROM cj GROUP BY id)"""


# Neighbours


def knn_sql(k: int) -> str:
    return f"""WITH {SQL_E}, p AS (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM p)
SELECT src, rank, dst, round(d, 6) AS dist FROM r WHERE rank <= {k}"""


@query(knn_sql(8))
def knn_exact(spark, d):
    return neighbors.knn(embeddings(spark, d), 8).select("src", F.col("rank").cast("long").alias("rank"), "dst", near("dist", 6).alias("dist"))


@query(f"SELECT src, dst, dist FROM ({knn_sql(1)})")
def nn_rank1(spark, d):
    return neighbors.knn(embeddings(spark, d), 1).select("src", "dst", near("dist", 6).alias("dist"))


@query(f"""WITH w AS ({knn_sql(8)}) SELECT src, list(dst ORDER BY rank)[8] AS last, count(*) AS n FROM w GROUP BY src""")
def knn_wide(spark, d):
    return neighbors.wide(neighbors.knn(embeddings(spark, d), 8), 8).select("src", F.get("dst", F.lit(7)).alias("last"), F.size("dst").cast("long").alias("n"))


@query(f"""WITH w AS ({knn_sql(8)}) SELECT src, dst FROM w WHERE rank > 3""")
def anti_join_neighbors(spark, d):
    """The 8 nearest that aren't among the 3 nearest; these are the first 3 of the 8, so that one search finds both."""
    return neighbors.knn(embeddings(spark, d), 8).where(F.col("rank") > 3).select("src", "dst")


SQL_P = "p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"


def part_points(spark, d):
    return tables.points(tables.table(spark, d, "part"), "p_partkey", "p_size", "p_retailprice")


@query(f"""WITH {SQL_P}, q AS (SELECT a.id AS src, b.id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM q) SELECT src, rank, dst, round(sqrt(d2), 6) AS dist FROM r WHERE rank <= 5""")
def knn_lowdim(spark, d):
    return neighbors.knn_points(part_points(spark, d), 5).select("src", F.col("rank").cast("long").alias("rank"), "dst", near("dist", 6).alias("dist"))


@query(ORACLE_SQL["knn_lowdim"])
def knn_walk(spark, d):
    """The same by joins, as for points that no worker can hold."""
    return neighbors.knn_points(part_points(spark, d), 5, limit=0).select("src", F.col("rank").cast("long").alias("rank"), "dst", near("dist", 6).alias("dist"))


@query(ORACLE_SQL["knn_exact"])
def knn_blocks(spark, d):
    """The same with both sides in blocks on the executors, as for a base that no worker can hold."""
    e = embeddings(spark, d)
    return neighbors.top_k(neighbors.candidates(e, e, 8, itself=True, limit=0), 8).select("src", F.col("rank").cast("long").alias("rank"), "dst", near("dist", 6).alias("dist"))


@query(f"""WITH {SQL_P} SELECT a.id AS src, b.id AS dst, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 4) AS d2 FROM p a JOIN p b
ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 2.25""")
def radius_join(spark, d):
    return neighbors.radius_join(part_points(spark, d), 1.5, digits=4)


@query(f"WITH {SQL_E} SELECT a.id AS src, b.id AS dst, round(list_distance(a.v, b.v) ** 2, 4) AS d2 FROM e a JOIN e b ON b.id = a.id + 1")
def pair_distances(spark, d):
    e = embeddings(spark, d)
    return neighbors.pair_distances(e.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), e).select("src", "dst", near("d2").alias("d2"))


MORTON = " | ".join(f"(((s >> {b}) & 1) << {2 * b + 1}) | (((t >> {b}) & 1) << {2 * b})" for b in range(16))
SQL_M = f"m AS (SELECT id, {MORTON} AS code, x, y FROM (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS s, CAST(floor(p_retailprice) AS BIGINT) AS t, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part))"


def part_codes(spark, d):
    p = tables.table(spark, d, "part")
    code = expr.morton_integers([F.col("p_size"), F.floor("p_retailprice")], 16)
    return p.select(F.col("p_partkey").alias("id"), code.alias("code"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("features"))


@query(f"WITH {SQL_M} SELECT id, code FROM m")
def morton_code_2d(spark, d):
    return part_codes(spark, d).select("id", "code")


@query(f"WITH {SQL_M} SELECT id, row_number() OVER (ORDER BY code, id) - 1 AS z FROM m")
def zorder(spark, d):
    return neighbors.zorder(part_codes(spark, d)).select("id", "z")


SQL_L = SQL_M + """, l AS (SELECT *, (row_number() OVER (ORDER BY code, id) - 1) // 48 AS leaf FROM m),
b AS (SELECT leaf, count(*) AS npart, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS cx, avg(y) AS cy FROM l GROUP BY leaf)"""


def part_leaves(spark, d):
    return neighbors.zorder(part_codes(spark, d)).withColumn("leaf", F.floor(F.col("z") / 48).cast("long"))


@query(f"WITH {SQL_L} SELECT leaf, npart, x0, x1, y0, y1, round(cx, 6) AS cx, round(cy, 6) AS cy FROM b")
def leaf_boxes(spark, d):
    b = neighbors.boxes(part_leaves(spark, d))
    return b.select("leaf", "npart", F.col("low")[0].alias("x0"), F.col("high")[0].alias("x1"), F.col("low")[1].alias("y0"), F.col("high")[1].alias("y1"), near(F.col("centre")[0], 6).alias("cx"), near(F.col("centre")[1], 6).alias("cy"))


@query(f"""WITH {SQL_L} SELECT s.leaf AS a, t.leaf AS b, round(greatest(t.x0 - s.x1, s.x0 - t.x1, 0) ** 2 + greatest(t.y0 - s.y1, s.y0 - t.y1, 0) ** 2, 4) AS d2 FROM b s JOIN b t ON true""")
def box_pair_dist(spark, d):
    b = neighbors.boxes(part_leaves(spark, d))
    return neighbors.box_pairs(b, b, digits=4)


@query(f"""WITH {SQL_L}, top AS (SELECT max(leaf) AS m FROM l) SELECT CAST(v AS INTEGER) AS level, CAST(leaf // CAST(8 ** v AS BIGINT) AS BIGINT) AS node, count(*) AS npart, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy
FROM l, top, unnest(range(0, 12)) t(v) WHERE v = 0 OR m // CAST(8 ** (v - 1) AS BIGINT) > 0 GROUP BY ALL""")
def spatial_tree(spark, d):
    t = neighbors.tree(part_leaves(spark, d))
    return t.select("level", "node", "npart", near(F.col("centre")[0]).alias("cx"), near(F.col("centre")[1]).alias("cy"))


@query()
def nndescent_graph(spark, d):
    return nndescent.NNDescent(k=10, seed=1).build(embeddings(spark, d)).select("src", "rank", "dst", near("dist", 6).alias("dist"))


# Kernels

KERNELS = {"linear": "list_inner_product(e.v, c.v)", "rbf": "exp(-0.5 * list_distance(e.v, c.v) ** 2)", "poly": "(0.5 * list_inner_product(e.v, c.v) + 1) ** 3", "sigmoid": "tanh(0.5 * list_inner_product(e.v, c.v) + 1)"}


def _kernel(name: str):
    def run(spark, d):
        k = kernels.pairwise_kernel(embeddings(spark, d), centroids(spark, d), kernel=name, gamma=0.5)
        return k.select("i", "j", near("k", 6).alias("k"))

    run.__name__ = f"kernel_{name}"
    return query(f"WITH {SQL_C} SELECT e.id AS i, c.id AS j, round({KERNELS[name]}, 6) + 0.0 AS k FROM e JOIN c ON true")(run)


for _name in KERNELS:
    _kernel(_name)

CENTRED = f"""WITH {SQL_E}, k AS (SELECT a.id AS i, b.id AS j, list_inner_product(a.v, b.v) AS k FROM e a JOIN e b ON true)
SELECT i, j, round(k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER (), 6) + 0.0 AS k FROM k"""


@query(CENTRED)
def kernel_centered(spark, d):
    return kernels.centred_kernel(embeddings(spark, d), kernel="linear", digits=6)


@query(f"WITH {SQL_E} SELECT a.id, round(sum(exp(-1.0 * (list_distance(a.v, b.v) ** 2))), 4) AS s FROM e a JOIN e b ON true GROUP BY a.id")
def nystroem_full_rank(spark, d):
    """With all rows as anchors Z Z^T is K: its row sums."""
    return kernels.Nystroem(n_components=None, gamma=1.0).row_sums(embeddings(spark, d)).select("id", near("s").alias("s"))


@query(f"SELECT i AS id, round(k, 4) + 0.0 AS s FROM ({CENTRED.replace(", 6) + 0.0 AS k", ", 14) AS k").replace('list_inner_product(a.v, b.v)', 'exp(-1.0 * (list_distance(a.v, b.v) ** 2))')}) WHERE i = j")
def kpca_full_rank(spark, d):
    """With all components Z Z^T is the centred kernel: its diagonal."""
    return kernels.KernelPCA(None, gamma=1.0).squared_norms(embeddings(spark, d)).select("id", near("s").alias("s"))


# Sparse


@query(f"WITH {SQL_E} SELECT id AS i, j - 1 AS j, round(v[j], 6) AS v FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS j FROM e) WHERE abs(v[j]) > 0.1")
def csr_from_dense(spark, d):
    return sparse.from_dense(embeddings(spark, d), "id", "features", 0.1).select("i", "j", near("v", 6).alias("v"))


@query(f"""WITH {SQL_E}, n AS (SELECT id AS i, len(list_filter(v, lambda x: abs(x) > 0.2)) AS n FROM e)
SELECT i, CAST(sum(n) OVER (ORDER BY i) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY i) AS BIGINT) AS stop FROM n""")
def csr_indptr(spark, d):
    e = embeddings(spark, d)
    return sparse.row_pointers(sparse.from_dense(e, "id", "features", 0.2), e, "id").select("i", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def _lineitem(spark, d, where: str = "true"):
    return tables.table(spark, d, "lineitem").where(where).groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


def _parts(spark, d):
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("j"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("row"))


@query("SELECT l_suppkey AS i, round(sum(l_quantity * p_size), 2) AS c0, round(sum(l_quantity * p_retailprice), 2) AS c1 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def spmm(spark, d):
    return sparse.spmm(_lineitem(spark, d), _parts(spark, d)).select("i", near(F.col("c")[0], 2).alias("c0"), near(F.col("c")[1], 2).alias("c1"))


@query("""SELECT s_suppkey AS i, round(coalesce(sum(l_quantity * p_size), 0), 2) AS c0, round(coalesce(sum(l_quantity * p_retailprice), 0), 2) AS c1
FROM supplier LEFT JOIN (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49.9 AND l_discount > 0.09) ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def spmm_empty_rows(spark, d):
    rows = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"))
    return sparse.spmm(_lineitem(spark, d, "l_quantity > 49.9 AND l_discount > 0.09"), _parts(spark, d), rows).select("i", near(F.col("c")[0], 2).alias("c0"), near(F.col("c")[1], 2).alias("c1"))


# Batched linear algebra on the Gram matrices of each supplier's lines

SQL_G = """g AS (SELECT s AS id, avg(q * q) AS a, avg(q * u) AS b, avg(q * t) AS c, avg(u * u) AS d, avg(u * t) AS e, avg(t * t) AS f, avg(q * p) AS p1, avg(u * p) AS p2, avg(q) AS m, avg(p) AS n
FROM (SELECT l_suppkey AS s, l_quantity AS q, l_discount * 100 AS u, l_tax * 100 AS t, l_extendedprice / 1000 AS p FROM lineitem) GROUP BY s)"""
SQL_F = SQL_G + ", l AS (SELECT *, sqrt(a) AS l11, b / sqrt(a) AS l21, sqrt(d - b * b / a) AS l22 FROM g)"


def grams(spark, d):
    q, u, t, p = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_extendedprice") / 1000
    pairs = {"a": q * q, "b": q * u, "c": q * t, "d": u * u, "e": u * t, "f": t * t, "p1": q * p, "p2": u * p, "m": q, "n": p}
    g = tables.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(*[F.avg(v).alias(k) for k, v in pairs.items()])
    two = F.array(F.array("a", "b"), F.array("b", "d"))
    three = F.array(F.array("a", "b", "c"), F.array("b", "d", "e"), F.array("c", "e", "f"))
    return g.withColumn("m2", two).withColumn("m3", three).withColumn("rhs", F.array("p1", "p2"))


@query(f"WITH {SQL_F} SELECT id, round(l11, 4) AS l11, round(l21, 4) AS l21, round(l22, 4) AS l22, 0.0 AS l12 FROM l")
def cholesky_2x2(spark, d):
    g = grams(spark, d).select("id", linalg.cholesky(F.col("m2")).alias("l"))
    at = lambda i, j: near(F.col("l")[i][j])
    return g.select("id", at(0, 0).alias("l11"), at(1, 0).alias("l21"), at(1, 1).alias("l22"), at(0, 1).alias("l12"))


def _two(g: DataFrame, x: Column) -> DataFrame:
    return g.select("id", x.alias("x")).select("id", near(F.col("x")[0]).alias("x1"), near(F.col("x")[1]).alias("x2"))


@query(f"WITH {SQL_G} SELECT id, round((p1 * d - b * p2) / (a * d - b * b), 4) AS x1, round((a * p2 - b * p1) / (a * d - b * b), 4) AS x2 FROM g")
def solve_spd(spark, d):
    return _two(grams(spark, d), linalg.solve(F.col("m2"), F.col("rhs")))


@query(f"WITH {SQL_G} SELECT id, round((p1 * d - b * p2) / (a * d - b * b), 4) AS x1, round((a * p2 - b * p1) / (a * d - b * b), 4) AS x2 FROM g")
def solve_cholesky(spark, d):
    g = grams(spark, d)
    x = linalg.solve_cholesky(F.col("m2"), F.array(F.array("p1"), F.array("p2")), vector=False)
    return g.select("id", x.alias("x")).select("id", near(F.col("x")[0][0]).alias("x1"), near(F.col("x")[1][0]).alias("x2"))


@query(f"WITH {SQL_G} SELECT id, round((p1 * c - a * p2) / (b * c - a * e), 4) AS x1, round((b * p2 - e * p1) / (b * c - a * e), 4) AS x2 FROM g")
def solve_lu_2x2(spark, d):
    return _two(grams(spark, d), linalg.solve_lu(F.array(F.array("b", "a"), F.array("e", "c")), F.col("rhs")))


@query(f"WITH {SQL_F} SELECT id, round(p1 / l11, 4) AS x1, round((p2 - l21 * p1 / l11) / l22, 4) AS x2 FROM l")
def tril_solve(spark, d):
    g = grams(spark, d).withColumn("l", linalg.cholesky(F.col("m2")))
    return _two(g, linalg.tril_solve(F.col("l"), F.col("rhs")))


@query(f"WITH {SQL_F} SELECT id, round((p1 - l21 * p2 / l22) / l11, 4) AS x1, round(p2 / l22, 4) AS x2 FROM l")
def triu_solve(spark, d):
    g = grams(spark, d).withColumn("l", linalg.cholesky(F.col("m2")))
    return _two(g, linalg.triu_solve(F.col("l"), F.col("rhs")))


@query(f"""WITH {SQL_G}, h AS (SELECT *, sqrt(a * a + b * b) AS n1 FROM g) SELECT id, round(-n1, 4) AS r11, round(-(a * b + b * d) / n1, 4) AS r12, round(-(a * d - b * b) / n1, 4) AS r22, round(-a / n1, 4) AS q11, round(-b / n1, 4) AS q21 FROM h""")
def qr_2x2(spark, d):
    g = grams(spark, d).select("id", linalg.qr(F.col("m2")).alias("x")).select("id", "x.q", "x.r")
    return g.select("id", near(F.col("r")[0][0]).alias("r11"), near(F.col("r")[0][1]).alias("r12"), near(F.col("r")[1][1]).alias("r22"), near(F.col("q")[0][0]).alias("q11"), near(F.col("q")[1][0]).alias("q21"))


DET3 = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"


@query(f"WITH {SQL_G} SELECT id, round({DET3}, 2) AS det FROM g")
def det3(spark, d):
    return grams(spark, d).select("id", near(linalg.det(F.col("m3")), 2).alias("det"))


@query(f"WITH {SQL_G} SELECT id, CAST(sign({DET3}) AS DOUBLE) AS sign, round(ln(abs({DET3})), 4) AS logabsdet FROM g")
def slogdet3(spark, d):
    return grams(spark, d).select("id", linalg.slogdet(F.col("m3")).alias("x")).select("id", "x.sign", near("x.logabsdet").alias("logabsdet"))


@query(f"WITH {SQL_G} SELECT id, round(ln({DET3}), 4) AS logdet FROM g")
def logdet_spd(spark, d):
    return grams(spark, d).select("id", near(linalg.logdet_spd(F.col("m3"))).alias("logdet"))


@query(f"WITH {SQL_G} SELECT id, round(n - m * (p1 - m * n) / (a - m * m), 4) AS x1, round((p1 - m * n) / (a - m * m), 4) AS x2 FROM g")
def ols_by_group(spark, d):
    """Price on quantity with an intercept, by supplier."""
    return _two(grams(spark, d), linalg.solve(F.array(F.array(F.lit(1.0), F.col("m")), F.array("m", "a")), F.array("n", "p1")))


# Decompositions

SQL_J = SQL_E + ", x AS (SELECT id, j - 1 AS j, v[j] AS x FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS j FROM e))"


@query(f"WITH {SQL_J} SELECT j, round(avg(x), 6) + 0.0 AS x FROM x GROUP BY j")
def pca_mean(spark, d):
    m = decomposition.PCA(1 << 20).fit(embeddings(spark, d))
    return spark.createDataFrame([(j, float(x)) for j, x in enumerate(m.mean_)], "j long, x double").select("j", near("x", 6).alias("x"))


@query(f"WITH {SQL_J}, s AS (SELECT var_samp(x) AS v FROM x GROUP BY j) SELECT round(sum(v), 6) AS total, round(sum(v), 6) AS explained, 1.0 AS ratio FROM s")
def pca_total_var(spark, d):
    m = decomposition.PCA(1 << 20).fit(embeddings(spark, d))
    total = float((m.singular_values_**2).sum() / (m.n_samples_ - 1))
    row = [(total, float(m.explained_variance_.sum()), float(m.explained_variance_ratio_.sum()))]
    return spark.createDataFrame(row, "total double, explained double, ratio double").select(*[near(c, 6).alias(c) for c in ("total", "explained", "ratio")])


@query(f"WITH {SQL_J} SELECT id, j, round(x, 4) + 0.0 AS x FROM x")
def pca_roundtrip(spark, d):
    e = embeddings(spark, d)
    m = decomposition.PCA(1 << 20, whiten=True).fit(e)
    return long(m.inverse_transform(m.transform(e).select("id", "z")), "id", "features")


@query(f"WITH {SQL_J} SELECT j, 1.0 AS x FROM x GROUP BY j")
def pca_whitened_variance(spark, d):
    e = embeddings(spark, d)
    z = decomposition.PCA(1 << 20, whiten=True).fit_transform(e)
    return z.select(F.posexplode("z").alias("j", "x")).groupBy("j").agg(near(F.var_samp("x")).alias("x")).select(F.col("j").cast("long").alias("j"), "x")


@query(f"WITH {SQL_J} SELECT round(sum(x * x), 4) AS energy FROM x")
def svd_energy(spark, d):
    s, _, _, _ = decomposition.randomized_svd(embeddings(spark, d), 1 << 20)
    return spark.createDataFrame([(float((s**2).sum()),)], "energy double").select(near("energy").alias("energy"))


@query(f"WITH {SQL_J} SELECT id, round(sum(x * x), 4) AS s FROM x GROUP BY id")
def tsvd_gram(spark, d):
    z = decomposition.TruncatedSVD(1 << 20).fit_transform(embeddings(spark, d))
    return z.select("id", near(expr.squared_norm(F.col("z"))).alias("s"))


@query()
def randomized_svd_top(spark, d):
    s, v, _, _ = decomposition.randomized_svd(embeddings(spark, d), 4, solver="sketch")
    return spark.createDataFrame([(i, float(x), float(np.linalg.norm(r))) for i, (x, r) in enumerate(zip(s, v, strict=True))], "i long, s double, norm double").select("i", near("s", 2).alias("s"), near("norm").alias("norm"))


def _batches(spark, d):
    return tables.table(spark, d, "embeddings").select(F.col("label").alias("batch_id"), F.col("vec_id").alias("row_id"), F.col("embedding").alias("features"))


@query(f"WITH {SQL_E}, x AS (SELECT label, v[j] AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS j FROM e)) SELECT label AS batch_id, round(sum(x * x), 4) AS energy FROM x GROUP BY label")
def batched_svd(spark, d):
    """All singular values of each label's matrix: their squares add up to its elements'."""
    s = decomposition.batched_svd(_batches(spark, d), 1 << 20)
    return s.select("batch_id", near(expr.squared_norm(F.col("s"))).alias("energy"))


@query()
def batched_svd_sketch(spark, d):
    return decomposition.batched_svd(_batches(spark, d), 4, solver="sketch").select("batch_id", F.posexplode("s").alias("j", "s")).select("batch_id", F.col("j").cast("long").alias("j"), near("s").alias("s"))


@query(f"""WITH {SQL_E}, x AS (SELECT label, j, v[j] AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS j FROM e)), s AS (SELECT label, j, var_samp(x) AS v, avg(x) AS m, count(*) AS n FROM x GROUP BY label, j)
SELECT label AS batch_id, any_value(n) AS n, round(sum(v), 6) AS total, round(sum(m), 6) + 0.0 AS mean, 1.0 AS ratio FROM s GROUP BY label""")
def batched_pca(spark, d):
    m = decomposition.batched_pca(_batches(spark, d), 1 << 20)
    return m.select("batch_id", "n", near(expr.total(F.col("explained_variance")), 6).alias("total"), near(expr.total(F.col("mean")), 6).alias("mean"), near(expr.total(F.col("explained_variance_ratio")), 6).alias("ratio"))


@query(f"WITH {SQL_J} SELECT id AS row_id, j, round(x, 4) + 0.0 AS x FROM x")
def batched_pca_roundtrip(spark, d):
    rows = _batches(spark, d)
    models = decomposition.batched_pca(rows, 1 << 20)
    z = decomposition.batched_transform(rows, models, whiten=True).select("batch_id", "row_id", "z")
    return long(decomposition.batched_transform(z, models, features_col="z", output_col="features", whiten=True, inverse=True), "row_id", "features")


# Projections


def _list(v) -> str:
    return "[" + ", ".join(repr(float(x)) for x in v) + "]"


def _projected(matrices: list[np.ndarray]) -> str:
    """SQL for (member, id, j, x): the rows of the matrices as literals."""
    rows = [f"SELECT {m} AS member, {j} AS j, CAST({_list(r)} AS DOUBLE[]) AS r" for m, matrix in enumerate(matrices) for j, r in enumerate(matrix)]
    return f"WITH {SQL_E}, r AS ({' UNION ALL '.join(rows)}) SELECT CAST(member AS BIGINT) AS member, id, CAST(j AS BIGINT) AS j, list_inner_product(v, r) AS x FROM e JOIN r ON true"


DIM = 64


def _gaussian(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((k, DIM)) / np.sqrt(k)


def _ternary(k: int, seed: int) -> np.ndarray:
    rng, density = np.random.default_rng(seed), 1 / np.sqrt(DIM)
    mask = rng.random((k, DIM)) < density
    return mask * np.where(rng.random((k, DIM)) < 0.5, 1.0, -1.0) * np.sqrt(1 / (density * k))


MEMBERS = [_ternary(4, 43), _ternary(4, 44), _gaussian(4, 45), _gaussian(4, 46)]
ENSEMBLE = projection.EnsembleRandomProjection(4, n_pca=0)


@query(f"SELECT id, j, round(x, 4) + 0.0 AS x FROM ({_projected([_gaussian(8, 42)])})")
def gaussian_rp(spark, d):
    return long(projection.GaussianRandomProjection(8).fit_transform(embeddings(spark, d)), "id", "z")


@query(f"SELECT id, j, round(x, 4) + 0.0 AS x FROM ({_projected([_ternary(8, 42)])})")
def sparse_rp(spark, d):
    return long(projection.SparseRandomProjection(8).fit_transform(embeddings(spark, d)), "id", "z")


@query(f"SELECT id AS i, j, round(x, 4) + 0.0 AS x FROM ({_projected([_ternary(8, 42)])})")
def sparse_rp_join(spark, d):
    e = embeddings(spark, d)
    return long(projection.SparseRandomProjection(8, store_sparse=True).fit(e).transform_sparse(e), "i", "c")


@query(f"SELECT member, id, j, round(x, 4) + 0.0 AS x FROM ({_projected(MEMBERS)})")
def ensemble_long(spark, d):
    e = embeddings(spark, d)
    z = ENSEMBLE.fit(e).transform(e)
    return z.select(F.col("member").cast("long").alias("member"), "id", F.posexplode("z").alias("j", "x")).select("member", "id", F.col("j").cast("long").alias("j"), near("x").alias("x"))


@query(f"""WITH {SQL_J}, m AS (SELECT j, avg(x) AS m FROM x GROUP BY j) SELECT CAST(0 AS BIGINT) AS member, id, round(sum((x - m) * (x - m)), 4) AS s FROM x JOIN m USING (j) GROUP BY id
UNION ALL SELECT member + 1, id, round(sum(x * x), 4) FROM ({_projected([_gaussian(DIM, 43)])}) GROUP BY member, id""")
def ensemble_with_pca(spark, d):
    """A member of all principal components keeps each row's distance from the mean; with it a Gaussian one."""
    e = embeddings(spark, d)
    z = projection.EnsembleRandomProjection(DIM, n_pca=1, n_sparse=0, n_gaussian=1).fit(e).transform(e)
    return z.select(F.col("member").cast("long").alias("member"), "id", near(expr.squared_norm(F.col("z"))).alias("s"))


@query(f"SELECT id, round(sum(x) / 4 + (SELECT avg(label) FROM embeddings), 4) AS prediction FROM ({_projected(MEMBERS)}) GROUP BY id")
def ensemble_mean(spark, d):
    e = embeddings(spark, d).join(tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("y")), "id")
    model = ENSEMBLE.fit(e)
    return projection.ensemble_mean_predict(model, lambda z, y, new: new.sum(axis=1) + y.mean(), e, e).select("id", near("prediction").alias("prediction"))


@query("SELECT o_orderpriority, CAST(floor(4 * ln(count(*)) / (0.01 / 2 - 0.001 / 3)) AS BIGINT) AS dims FROM orders GROUP BY o_orderpriority")
def jl_dim(spark, d):
    return tables.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).select("o_orderpriority", expr.jl_dimension(F.col("n")).alias("dims"))


# k-means from the labels' centroids


def _lloyd(rounds: int) -> str:
    ctes, c = [SQL_C], "c"
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS (SELECT e.id, arg_min(c.id, (list_distance(e.v, c.v), c.id)) AS label, min(list_distance(e.v, c.v)) AS d FROM e JOIN {c} c ON true GROUP BY e.id)")
        ctes.append(f"cj{i} AS (SELECT a.label, j, avg(e.v[j]) AS x FROM a{i} a JOIN e ON e.id = a.id, unnest(range(1, len(e.v) + 1)) u(j) GROUP BY ALL)")
        ctes.append(f"c{i} AS (SELECT label AS id, list(x ORDER BY j) AS v FROM cj{i} GROUP BY label)")
        c = f"c{i}"
    return "WITH " + ", ".join(ctes)


def _start(spark, d) -> np.ndarray:
    return kernels.gathered(centroids(spark, d), "id", "features")[1]


def _model(spark, d, rounds: int) -> cluster.KMeansModel:
    return cluster.KMeans(10, init=_start(spark, d), max_iter=rounds, tol=0.0).fit(embeddings(spark, d))


@query(_lloyd(0) + " SELECT id, CAST(label AS INTEGER) AS label FROM a0")
def kmeans_assign(spark, d):
    return cluster.KMeansModel(_start(spark, d), 0.0, 0).predict(embeddings(spark, d)).select("id", "label")


@query(_lloyd(0) + " SELECT id, CAST(label AS INTEGER) AS label FROM a0")
def kmeans_assign_expr(spark, d):
    return embeddings(spark, d).select("id", cluster.nearest_centre(F.col("features"), _start(spark, d).tolist()).alias("label"))


@query(_lloyd(0) + " SELECT label AS id, CAST(j - 1 AS BIGINT) AS j, round(x, 6) + 0.0 AS x FROM cj0")
def kmeans_step(spark, d):
    m = _model(spark, d, 1)
    rows = [(i, j, float(x)) for i, c in enumerate(m.cluster_centers_) for j, x in enumerate(c)]
    return spark.createDataFrame(rows, "id long, j long, x double").select("id", "j", near("x", 6).alias("x"))


@query(_lloyd(3) + " SELECT id, CAST(label AS INTEGER) AS label FROM a3")
def kmeans_fixed_init_3_iters(spark, d):
    return _model(spark, d, 3).predict(embeddings(spark, d)).select("id", "label")


@query(_lloyd(3) + " SELECT round(sum(d * d), 4) AS inertia FROM a3")
def kmeans_inertia(spark, d):
    return spark.createDataFrame([(_model(spark, d, 3).inertia_,)], "inertia double").select(near("inertia").alias("inertia"))


@query(f"WITH {SQL_C} SELECT e.id, c.id AS j, round(list_distance(e.v, c.v), 4) AS x FROM e JOIN c ON true")
def kmeans_transform(spark, d):
    return long(cluster.KMeansModel(_start(spark, d), 0.0, 0).transform(embeddings(spark, d)), "id", "distances")


@query()
def kmeans_fit(spark, d):
    e = embeddings(spark, d)
    return cluster.KMeans(10, n_init=1, max_iter=10).fit_predict(e).groupBy("label").agg(F.count("*").alias("n"))


# Index arithmetic


@query("SELECT c_custkey, CAST(sum(c_nationkey) OVER (ORDER BY c_custkey) - c_nationkey AS BIGINT) AS before FROM customer")
def exclusive_sum(spark, d):
    return arrays.exclusive_sum(tables.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n")), "c_custkey", "n").select("c_custkey", F.col("before").cast("long").alias("before"))


@query("SELECT c_custkey, CAST(count(*) FILTER (c_acctbal > 0) OVER (ORDER BY c_custkey) - CAST(c_acctbal > 0 AS BIGINT) AS BIGINT) AS at FROM customer")
def masked_prefix_sum(spark, d):
    return arrays.masked_prefix_sum(tables.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", F.col("c_acctbal") > 0).select("c_custkey", F.col("at").cast("long").alias("at"))


@query("SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS z, p_partkey FROM part")
def inverse_permutation(spark, d):
    order = ranked(tables.table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", name="z")
    return arrays.inverse_permutation(order.select("p_partkey", "z"), "p_partkey", "z").select(F.col("p_partkey").alias("z"), F.col("z").alias("p_partkey"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS at FROM events")
def bucket_prefix_sum(spark, d):
    return arrays.bucket_prefix_sum(tables.table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", "at")


@query("SELECT p_partkey, CAST(len(list_filter([10, 20, 30, 40], lambda k: k < p_size)) AS INTEGER) AS l, CAST(len(list_filter([10, 20, 30, 40], lambda k: k <= p_size)) AS INTEGER) AS r FROM part")
def search_sorted(spark, d):
    at = lambda side: arrays.search_sorted([10, 20, 30, 40], F.col("p_size"), side)
    return tables.table(spark, d, "part").select("p_partkey", at("left").alias("l"), at("right").alias("r"))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey >= 150 THEN 2 WHEN p_partkey >= 50 THEN 1 WHEN p_partkey >= 0 THEN 0 END AS BIGINT) AS segment FROM part")
def inverse_of_splits(spark, d):
    splits = spark.createDataFrame([(0, 0), (50, 1), (150, 2)], "start long, segment long")
    return arrays.inverse_of_splits(splits, tables.table(spark, d, "part").select("p_partkey"), "start", "segment", "p_partkey")


@query("SELECT n_nationkey, coalesce(CAST(r_regionkey AS BIGINT) * 100, CAST(n_regionkey AS BIGINT)) AS value FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def masked_scatter(spark, d):
    base = tables.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("value"))
    new = tables.table(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), (F.col("r_regionkey").cast("long") * 100).alias("value"))
    return arrays.masked_scatter(base, new, "n_nationkey", "value")


@query("SELECT CAST(a AS BIGINT) AS child_a, CAST(b AS BIGINT) AS child_b FROM region, unnest(range(0, r_regionkey)) x(a), unnest(range(10, 12)) y(b)")
def expand_pairs(spark, d):
    r = F.col("r_regionkey").cast("long")
    return arrays.expand_pairs(tables.table(spark, d, "region").select(F.lit(0).cast("long").alias("a_start"), r.alias("a_end"), F.lit(10).cast("long").alias("b_start"), F.lit(12).cast("long").alias("b_end")))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def where_true(spark, d):
    return arrays.where_true(tables.table(spark, d, "customer"), "c_custkey", F.col("c_acctbal") > 0)


@query("SELECT c_custkey, CAST(sum(c_nationkey) OVER (ORDER BY c_custkey) - c_nationkey AS BIGINT) AS before, CAST(sum(c_nationkey) OVER () AS BIGINT) AS total FROM customer")
def offset_sum(spark, d):
    rows, total = arrays.offset_sum(tables.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n")), "c_custkey", "n")
    return rows.select("c_custkey", F.col("before").cast("long").alias("before"), F.lit(total).cast("long").alias("total"))


SQL_Z = "z AS (SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS at, row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_size FROM part)"


def _permuted(spark, d):
    """A permutation of parts: their place by price (at) and by key (i)."""
    order = ranked(tables.table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_partkey", name="at")
    return ranked(order, "p_partkey", name="i")


@query(f"WITH {SQL_Z}, n AS (SELECT count(*) AS n FROM part) SELECT a.at, CAST(coalesce(b.at, n) AS BIGINT) AS i FROM z a LEFT JOIN z b ON b.i = a.at AND b.p_size > 25, n")
def masked_inverse(spark, d):
    return arrays.masked_inverse(_permuted(spark, d).select("at", "i", "p_size"), "at", "i", F.col("p_size") > 25).select("at", F.col("i").cast("long").alias("i"))


@query("""WITH k AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_custkey FROM customer WHERE c_acctbal > 0), n AS (SELECT row_number() OVER () - 1 AS i FROM customer)
SELECT n.i AS at, coalesce(CAST(c_custkey AS BIGINT), -1) AS value FROM n LEFT JOIN k ON n.i = k.i""")
def masked_to_dense(spark, d):
    rows = tables.table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("long").alias("value"), "c_acctbal")
    return arrays.masked_to_dense(rows, "c_custkey", "value", F.col("c_acctbal") > 0, -1)


@query("SELECT n_nationkey, CASE WHEN n_nationkey >= 3 AND n_nationkey < 7 THEN 100 + n_nationkey - 3 ELSE CAST(n_regionkey AS BIGINT) END AS value FROM nation")
def set_range(spark, d):
    base = tables.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("value"))
    return arrays.set_range(base, spark.range(6).select(F.col("id").alias("n_nationkey"), (F.col("id") + 100).alias("value")), 3, 7, "n_nationkey", "value")


@query("SELECT l_orderkey, l_linenumber, CAST((l_orderkey + 6) // 7 AS BIGINT) AS blocks FROM lineitem")
def div_ceil(spark, d):
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", expr.div_ceil(F.col("l_orderkey"), F.lit(7)).cast("long").alias("blocks"))


@query("SELECT e.o_orderkey, CAST(max(s.o_orderkey) AS BIGINT) AS segment FROM orders e ASOF LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) s ON e.o_orderkey >= s.o_orderkey GROUP BY e.o_orderkey")
def inverse_of_many_splits(spark, d):
    """As many segments as a third of the orders: beyond the bound they are sorted in among the rows."""
    o = tables.table(spark, d, "orders").select("o_orderkey")
    splits = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("long").alias("start"), F.col("o_orderkey").cast("long").alias("segment"))
    return arrays.inverse_of_splits(splits, o, "start", "segment", "o_orderkey", few=0)
