"""Sparse matrices as coordinate relations (i, j, v), and their products with dense ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_dense(df: DataFrame, id_col: str, features_col: str, tol: float = 0.0) -> DataFrame:
    """(i, j, v) of the elements with |v| > tol."""
    return df.select(F.col(id_col).alias("i"), F.posexplode(F.col(features_col)).alias("j", "v")).where(F.abs("v") > tol).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def row_pointers(coo: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """(i, start, stop): the running count of stored elements by row id, rows without any included. Counts per range of rows
    are added up on the driver (one number a partition); no window spans all rows."""
    counts = rows.select(F.col(id_col).alias("i")).join(coo.groupBy("i").agg(F.count("*").alias("n")), "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))
    return running_total(counts, "i", "n").select("i", (F.col("total") - F.col("n")).alias("start"), F.col("total").alias("stop"))


def running_total(df: DataFrame, order_col: str, value_col: str) -> DataFrame:
    """df with total: the inclusive running sum of value_col in ascending order of the unique order_col."""
    from pyspark.sql import Window

    from vecengine.plans.ranges import ranged

    part, bounds = ranged(df, order_col)
    sums = {r["_part"]: r["s"] for r in part.groupBy("_part").agg(F.sum(value_col).alias("s")).collect()}  # one row a range
    before, at = [], 0
    for p in range(len(bounds) + 1):
        before.append(at)
        at += sums.get(p, 0) or 0
    within = F.sum(value_col).over(Window.partitionBy("_part").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("total", within + F.element_at(F.lit(before), F.col("_part") + 1)).drop("_part")


def spmm(a: DataFrame, b: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """C = A B for a (i, j, v) and b (j, row: array<double>): (i, c: array<double>). rows (i) adds the empty ones as zeros.

    Products are added up before they move: the join is on j, the sum on (i, element).
    """
    joined = a.join(b, "j").select("i", "v", F.posexplode("row").alias("k", "x"))
    sums = joined.groupBy("i", "k").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
    c = sums.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("c"))
    if rows is None:
        return c
    width = b.select(F.size("row").alias("w")).limit(1).first()
    zero = F.array_repeat(F.lit(0.0), width["w"] if width else 0)
    return rows.join(c, "i", "left").select("i", F.coalesce("c", zero).alias("c"))


def spmv(a: DataFrame, b: DataFrame, value: Column | None = None) -> DataFrame:
    """(i, s) = A b for b (j, x)."""
    return a.join(b, "j").groupBy("i").agg(F.sum(F.col("v") * (value if value is not None else F.col("x"))).alias("s"))
