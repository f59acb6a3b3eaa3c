"""Column expressions on vectors, and conversion between Arrow lists and NumPy blocks."""
