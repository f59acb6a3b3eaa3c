"""Range partitioning whose bounds the driver knows, for ranks and running sums without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranged(df: DataFrame, key: str, parts: int | None = None) -> tuple[DataFrame, list]:
    """df with _part, the range of its key; and the ascending bounds between ranges. Equal keys share a range."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else None
    bounds = sorted(set(cuts or []))
    at = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    return df.withColumn("_part", F.when(F.col(key).isNull(), F.lit(0)).otherwise(at).cast("int")), bounds


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """df with the 0-based rank in the order of the columns; the first is the one that is cut into ranges."""
    from pyspark.sql import Window

    part, bounds = ranged(df, order[0])
    counts = {r["_part"]: r["n"] for r in part.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a range
    before, at = [], 0
    for p in range(len(bounds) + 1):
        before.append(at)
        at += counts.get(p, 0)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return part.withColumn(name, (within + F.element_at(F.lit(before).cast("array<long>"), F.col("_part") + 1)).cast("long")).drop("_part")
