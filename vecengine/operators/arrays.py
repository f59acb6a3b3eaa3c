"""Index arithmetic of array programs as relations: prefix sums, inverse permutations, segments, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecengine.operators.sparse import running_total
from vecengine.plans.ranges import ranged


def where_true(df: DataFrame, index_col: str, condition: Column) -> DataFrame:
    return df.where(condition).select(index_col)


def exclusive_sum(df: DataFrame, order_col: str, value_col: str, name: str = "before") -> DataFrame:
    """df with the sum of value_col over the rows before, in the order of order_col."""
    return running_total(df, order_col, value_col).withColumn(name, F.col("total") - F.col(value_col)).drop("total")


def masked_prefix_sum(df: DataFrame, order_col: str, mask: Column, name: str = "at") -> DataFrame:
    """df with the number of rows before this one that mask holds for."""
    return exclusive_sum(df.withColumn("_m", mask.cast("long")), order_col, "_m", name).drop("_m")


def offset_sum(df: DataFrame, order_col: str, value_col: str, name: str = "before") -> tuple[DataFrame, int]:
    """exclusive_sum, and the sum of all."""
    return exclusive_sum(df, order_col, value_col, name), df.agg(F.sum(value_col)).first()[0] or 0


def inverse_permutation(df: DataFrame, index_col: str, value_col: str) -> DataFrame:
    return df.select(F.col(value_col).alias(index_col), F.col(index_col).alias(value_col))


def masked_inverse(df: DataFrame, index_col: str, value_col: str, mask: Column) -> DataFrame:
    """(index, value): the index whose value this index is, of rows that mask holds for; the number of rows where none is. Indices are those of df."""
    n = df.count()
    found = df.where(mask).groupBy(F.col(value_col).alias(index_col)).agg(F.max(index_col).alias("_at"))
    return df.select(index_col).join(found, index_col, "left").select(index_col, F.coalesce("_at", F.lit(n)).alias(value_col))


def masked_to_dense(df: DataFrame, order_col: str, value_col: str, mask: Column, fill=0) -> DataFrame:
    """(at, value): the values that mask holds for, in order, at 0, 1, ...; fill from there to the number of rows."""
    n = df.count()
    kept = masked_prefix_sum(df.select(order_col, value_col, mask.alias("_k")), order_col, F.col("_k")).where("_k").select("at", value_col)
    every = df.sparkSession.range(n).select(F.col("id").alias("at"))
    return every.join(kept.withColumn("_some", F.lit(True)), "at", "left").select("at", F.when(F.col("_some"), F.col(value_col)).otherwise(F.lit(fill)).alias(value_col))


def set_range(base: DataFrame, values: DataFrame, start: int, end: int, index_col: str, value_col: str) -> DataFrame:
    """base with the values (index from 0) at start .. end; others stay."""
    moved = values.withColumn(index_col, F.col(index_col) + start).where(F.col(index_col) < end)
    return masked_scatter(base, moved, index_col, value_col)


#: Segments' starts that go out as one array.
FEW_SPLITS = 10_000


def inverse_of_splits(splits: DataFrame, rows: DataFrame, start_col: str, segment_col: str, index_col: str, few: int = FEW_SPLITS) -> DataFrame:
    """rows (index) with the segment whose start is the last at or before it, the last one of equal starts; null before the first.

    Up to few starts go out as one array; more of them are sorted in among the rows, and each row takes the last start before it within
    its range of indices, or that of the ranges before.
    """
    if splits.limit(few + 1).count() <= few:
        starts = sorted((r[0], r[1]) for r in splits.select(start_col, segment_col).collect())
        at = F.size(F.filter(F.lit([s for s, _ in starts]), lambda s: s <= F.col(index_col)))
        return rows.withColumn(segment_col, F.when(at > 0, F.element_at(F.lit([g for _, g in starts]), F.greatest(at, F.lit(1)))))
    both = rows.withColumn("_s", F.lit(None).cast(splits.schema[segment_col].dataType)).withColumn("_k", F.lit(1))
    both = both.unionByName(splits.select(F.col(start_col).alias(index_col), F.col(segment_col).alias("_s"), F.lit(0).alias("_k")), allowMissingColumns=True)
    part, bounds = ranged(both, index_col)
    last = {r["_part"]: r["s"]["_s"] for r in part.where("_k = 0").groupBy("_part").agg(F.max(F.struct(index_col, "_s")).alias("s")).collect()}  # one row a range
    before, held = [], None
    for p in range(len(bounds) + 1):
        before.append(held)
        held = last.get(p, held)
    own = F.last("_s", ignorenulls=True).over(Window.partitionBy("_part").orderBy(index_col, "_k", "_s").rowsBetween(Window.unboundedPreceding, 0))
    carried = F.element_at(F.array(*[F.lit(x) for x in before]), F.col("_part") + 1)
    return part.withColumn("_o", F.coalesce(own, carried)).where("_k = 1").drop("_s", "_k", "_part").withColumnRenamed("_o", segment_col)


def search_sorted(keys: list, value: Column, side: str = "left") -> Column:
    """The place at which value goes into the ascending keys."""
    if side not in ("left", "right"):
        raise ValueError("side is left or right")
    return F.size(F.filter(F.lit(keys), lambda k: (k < value) if side == "left" else (k <= value)))


def bucket_prefix_sum(df: DataFrame, key_col: str, order_col: str, name: str = "at") -> DataFrame:
    """df with its number among the rows of its key, from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(key_col).orderBy(order_col)) - 1).cast("long"))


def masked_scatter(base: DataFrame, updates: DataFrame, index_col: str, value_col: str) -> DataFrame:
    """base with the values that updates has for some indices."""
    new = updates.select(index_col, F.col(value_col).alias("_new"))
    return base.join(new, index_col, "left").withColumn(value_col, F.coalesce("_new", value_col)).drop("_new")


def expand_pairs(pairs: DataFrame) -> DataFrame:
    """All (child_a, child_b) of pairs of half-open ranges (a_start, a_end, b_start, b_end)."""
    def span(a, b):
        return F.when(F.col(b) > F.col(a), F.sequence(F.col(a), F.col(b) - 1)).otherwise(F.array().cast("array<long>"))

    first = pairs.select(F.explode(span("a_start", "a_end")).alias("child_a"), "b_start", "b_end")
    return first.select("child_a", F.explode(span("b_start", "b_end")).alias("child_b"))
