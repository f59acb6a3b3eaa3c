"""PySpark-native analytics over DataFrames of vectors and small matrices."""

__version__ = "0.1.0"
