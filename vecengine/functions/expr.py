"""Vector algebra as built-in column expressions: for once-per-row work. Quadratic work belongs to block kernels."""

from __future__ import annotations



from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def squared_norm(a: Column) -> Column:
    return total(F.transform(as_double(a), lambda x: x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def kernel(a: Column, b: Column, name: str, gamma: float, degree: float = 3, coef0: float = 1.0) -> Column:
    """linear, rbf, poly or sigmoid kernel of two vectors."""
    if name == "linear":
        return dot(a, b)
    if name == "rbf":
        return F.exp(-gamma * squared_distance(a, b))
    if name == "poly":
        return F.pow(gamma * dot(a, b) + coef0, F.lit(float(degree)))
    if name == "sigmoid":
        return F.tanh(gamma * dot(a, b) + coef0)
    raise ValueError(f"unknown kernel {name!r}")


def box_distance_squared(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """The least squared distance between two axis-aligned boxes; 0 if they meet."""
    gaps = F.zip_with(F.zip_with(low_b, high_a, lambda x, y: x - y), F.zip_with(low_a, high_b, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return squared_norm(gaps)


def div_ceil(a: Column, b: Column) -> Column:
    return F.ceil(a / b)


def transposed(m: Column) -> Column:
    """The transpose of array<array<double>>."""
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))


def log_det_of_factor(lower: Column) -> Column:
    """2 * sum(log diag L)."""
    return 2 * total(F.transform(lower, lambda row, i: F.log(F.get(row, i))))


def jl_dimension(n: Column, eps: float = 0.1) -> Column:
    """Johnson-Lindenstrauss: dimensions that keep n points' distances within eps, truncated."""
    if not 0 < eps < 1:
        raise ValueError("eps must lie between 0 and 1")
    return F.floor(4 * F.log(n.cast("double")) / (eps**2 / 2 - eps**3 / 3)).cast("long")


def spread_bits(x: Column, dims: int, bits: int) -> Column:
    """The low bits of a non-negative integer, dims apart."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), b).bitwiseAND(F.lit(1)), b * dims))
    return out


def morton_integers(coordinates: list[Column], bits: int) -> Column:
    """The Morton code of non-negative integers; the first axis is the most significant."""
    dims = len(coordinates)
    if not 2 <= dims <= 10 or bits * dims > 63:
        raise ValueError("2 to 10 axes and at most 63 bits")
    out = F.lit(0).cast("long")
    for i, c in enumerate(coordinates):
        out = out.bitwiseOR(F.shiftleft(spread_bits(c, dims, bits), dims - 1 - i))
    return out


