"""Vectors and symmetric matrices held in arrays; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_triangle(flat: Column, n: int) -> Column:
    """Cells i < j of a row-major n x n matrix, row by row; raises on another size."""
    places = [i * n + j for i in range(n) for j in range(i + 1, n)]
    cells = F.transform(F.lit(places), lambda k: F.get(flat, k))
    return F.when(F.size(flat) == n * n, cells).otherwise(F.raise_error(F.lit(f"not a {n} x {n} matrix")))


def edges_or_matrix(y: Column, n: int) -> Column:
    """A matrix's upper triangle where the array has n * n cells, any other array as it is."""
    places = [i * n + j for i in range(n) for j in range(i + 1, n)]
    return F.when(F.size(y) == n * n, F.transform(F.lit(places), lambda k: F.get(y, k))).otherwise(y)


def full_matrix(edge: Column, n: int, diagonal: float = 1.0) -> Column:
    """Row-major symmetric matrix of an upper triangle."""
    at = {}
    for i in range(n):
        for j in range(i + 1, n):
            at[i, j] = at[j, i] = len(at) // 2
    places = [at.get((i, j), -1) for i in range(n) for j in range(n)]
    return F.transform(F.lit(places), lambda k: F.when(k < 0, F.lit(diagonal)).otherwise(F.get(edge, F.greatest(k, F.lit(0)))))


def fisher_z(r: Column, eps: float = 1e-6) -> Column:
    """atanh of each value, clipped to 1 - eps in size."""
    return F.transform(r, lambda v: F.atanh(F.greatest(F.least(v, F.lit(1 - eps)), F.lit(eps - 1))))


def clipped(r: Column, eps: float = 1e-6) -> Column:
    """How many values fisher_z clips."""
    return F.size(F.filter(r, lambda v: F.abs(v) > 1 - eps)).cast("long")


def correlation_range(y: Column) -> Column:
    """Whether all values are finite and within 1.01 of 0."""
    return F.forall(y, lambda v: ~F.isnan(v) & (F.abs(v) <= 1.01))


def looks_like_correlations(y: Column, n: int | None = None) -> Column:
    """98% of values within 1.01 of 0 and, of an n x n matrix, 95% of the diagonal within 0.05 of 1."""
    share = F.size(F.filter(y, lambda v: F.abs(v) <= 1.01)) / F.size(y) >= 0.98
    if n is None:
        return share
    diagonal = F.transform(F.lit([i * n + i for i in range(n)]), lambda k: F.get(y, k))
    return share & (F.size(F.filter(diagonal, lambda v: F.abs(v - 1) <= 0.05)) / n >= 0.95)


def finite(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def squares(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: as the only element of an array that is mapped."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clr(x: Column, eps: float = 1e-6) -> Column:
    """Centred log-ratio of an array: shares of (value + eps), their ln, less the mean of these."""
    logs = _let(F.aggregate(x, F.lit(0.0), lambda t, v: t + v + eps), lambda s: F.transform(x, lambda v: F.log((v + eps) / s)))
    return _let(logs, lambda ls: _let(total(ls) / F.size(ls), lambda m: F.transform(ls, lambda v: v - m)))


def times(x: Column, matrix: list[list[float]]) -> Column:
    """Row vector times a small fixed matrix (as many rows as the vector has values)."""
    return F.array(*[F.aggregate(F.zip_with(x, F.lit([float(r[j]) for r in matrix]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for j in range(len(matrix[0]))])


def retention(w: Column, basis: list[list[float]]) -> Column:
    """Share of a vector's energy inside the span of orthonormal columns: |V'w|^2 / |w|^2, 0 for a zero vector."""
    return F.when(squares(w) > 0, squares(times(w, basis)) / squares(w)).otherwise(0.0)


def matrix_from_edges(z: Column, n: int, diagonal: float = 1.0 + 1e-4) -> Column:
    """Row-major matrix of Fisher-z edges: tanh of each, with a diagonal a little above 1."""
    return full_matrix(F.transform(z, F.tanh), n, diagonal)


def coupled(w: Column, basis: list[list[float]]) -> Column:
    """The part of a vector inside the span of orthonormal columns (n x k); the rest is its difference to the vector."""
    transposed = [list(c) for c in zip(*basis, strict=True)]
    return times(times(w, basis), transposed)
