"""Reading and writing: any Spark source is a source; these only shape its columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecengine.plans import strategy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(df: DataFrame, id_col: str, features_col: str) -> DataFrame:
    """(id, features: array<double>); only these two columns reach the scan."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(features_col).cast("array<double>").alias("features"))


def points(df: DataFrame, id_col: str, *axes: str | Column) -> DataFrame:
    """(id, features) from scalar columns, one for each axis."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.array(*[(F.col(a) if isinstance(a, str) else a).cast("double") for a in axes]).alias("features"))


def checked(df: DataFrame, features_col: str = "features") -> DataFrame:
    """df, after a check that its vectors all have one length and none is null."""
    strategy.shape(df, features_col)
    return df


def from_numpy(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """(id, features) from a matrix that the driver has."""
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(np.asarray(x, float))], "id long, features array<double>")


def to_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
