"""Vectors and matrices from tables, and results to tables."""
