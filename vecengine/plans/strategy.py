"""Size rules. Sizes come from counts, never from hope: a side is broadcast only if its bytes are known and small."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of a block product that is sent whole; elements of a block of scores; features up to which a Gram matrix is formed.
BROADCAST_BYTES, SCORE_ELEMENTS, GRAM_FEATURES = 128 << 20, 1 << 24, 2048
#: Rows that a method which needs an n x n matrix on the driver accepts.
DENSE_ROWS = 4096


def shape(df: DataFrame, features_col: str) -> tuple[int, int]:
    """Rows and features; raises ValueError if a vector is null, empty or of another length."""
    size = F.size(features_col)
    n, low, high, nulls = df.agg(F.count("*"), F.min(size), F.max(size), F.count(F.when(F.col(features_col).isNull(), 1))).first()
    if nulls or (n and (low != high or low <= 0)):
        raise ValueError(f"{features_col}: vectors must all have one length above 0 and none may be NULL")
    return n, low or 0


def fits(rows: int, features: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * features * 8 <= limit


def batch_rows(columns: int) -> int:
    """Rows of a block whose scores against so many columns stay within SCORE_ELEMENTS."""
    return max(1, SCORE_ELEMENTS // max(1, columns))


def width(df: DataFrame, features_col: str) -> int:
    """Elements of the first row's vector; 0 without rows or if it is null. Block maps hold all others against it."""
    row = df.select(F.size(features_col)).first()
    return max(0, row[0] or 0) if row else 0


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir. Where all run in one process it may be unset, and is set to a folder of our own."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/vecengine-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
