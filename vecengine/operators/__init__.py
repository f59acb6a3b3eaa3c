"""Operators over DataFrames of vectors and matrices."""
