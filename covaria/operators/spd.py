"""Symmetric positive definite matrices: repair, tangent vectors, distances and means.

A matrix is a row-major array of d * d numbers. Some megabytes of matrices are decomposed together inside tasks, as Arrow
holds them and never as an object a row; means are sums over rows, taken by Spark, of which one d x d matrix comes back.
A null matrix gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.operators.moments import AT_ONCE, cross_product
from covaria.sources.scratch import materialize

FLOOR, TANGENT_FLOOR = 1e-6, 1e-10


def _square(flat: np.ndarray) -> np.ndarray:
    return flat.reshape(len(flat), *[round(flat.shape[1] ** 0.5)] * 2)


def _stack(flat: np.ndarray) -> np.ndarray:
    m = _square(flat)
    return (m + m.transpose(0, 2, 1)) / 2


def _by_pieces(f: Callable[..., np.ndarray], *columns: pa.Array, kind: pa.DataType | None = None) -> pa.Array:
    """f of columns of arrays, AT_ONCE bytes of each at a time: a row of numbers or one value a row; null where a column is."""
    there = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    kept = [c.filter(pa.array(there)) for c in columns] if not there.all() else columns
    n, found = int(there.sum()), []
    if not n:
        return pa.nulls(len(there), kind or pa.list_(pa.float64()))
    blocks = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1) for c in kept]
    rows = max(1, AT_ONCE // (8 * max(1, *(b.shape[1] for b in blocks))))
    for start in range(0, n, rows):
        found.append(f(*(b[start : start + rows] for b in blocks)))
    values = np.concatenate(found)
    if kind:
        out = np.zeros(len(there), dtype=values.dtype)
        out[there] = values
        return pa.array(out, kind, mask=~there)
    ends = np.concatenate(([0], np.cumsum(there * values.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~there, False)), pa.array(values.ravel()))


def spectral(m: np.ndarray, f: Callable[[np.ndarray], np.ndarray], floor: float | None = TANGENT_FLOOR) -> np.ndarray:
    """f of the eigenvalues of symmetric matrices, which are raised to `floor` first."""
    w, v = np.linalg.eigh(m)
    return (v * f(np.maximum(w, floor) if floor is not None else w)[..., None, :]) @ np.swapaxes(v, -1, -2)


def _exp(w: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(w, -50, 50))


def make_spd(m: Column, floor: float = FLOOR) -> Column:
    """The symmetric part with eigenvalues raised to a floor."""

    @F.arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        return _by_pieces(lambda flat: spectral(_stack(flat), lambda w: w, floor).reshape(len(flat), -1), s)

    return run(m)


def is_spd(m: Column, least: float = -1e-8, tol: float = 1e-6) -> Column:
    """Symmetric within `tol` and no eigenvalue below `least`."""

    def told(flat: np.ndarray) -> np.ndarray:
        raw = _square(flat)
        return (np.abs(raw - raw.transpose(0, 2, 1)).max(axis=(1, 2)) <= tol) & (np.linalg.eigvalsh(_stack(flat))[:, 0] >= least)

    @F.arrow_udf("boolean")
    def run(s: pa.Array) -> pa.Array:
        return _by_pieces(told, s, kind=pa.bool_())

    return run(m)


def vectorize(m: np.ndarray) -> np.ndarray:
    """Diagonal, then the upper triangle times the root of 2, which keeps lengths."""
    at = np.triu_indices(m.shape[-1], 1)
    return np.concatenate([np.diagonal(m, axis1=-2, axis2=-1), np.sqrt(2) * m[..., at[0], at[1]]], axis=-1)


def unvectorize(v: np.ndarray) -> np.ndarray:
    d = int((np.sqrt(8 * v.shape[-1] + 1) - 1) / 2)
    m = np.zeros((*v.shape[:-1], d, d))
    at = np.triu_indices(d, 1)
    m[..., at[0], at[1]] = v[..., d:] / np.sqrt(2)
    m = m + np.swapaxes(m, -1, -2)
    m[..., np.arange(d), np.arange(d)] = v[..., :d]
    return m


METRICS = ("airm", "log_euclidean")


def _check(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; known: {', '.join(METRICS)}")


def _tangents(base: np.ndarray, metric: str) -> Callable[[np.ndarray], np.ndarray]:
    """Maps rows of matrices to their tangent vectors at a base point."""
    _check(metric)
    root, inverse, log_base = spectral(base, np.sqrt), spectral(base, lambda w: 1 / np.sqrt(w)), spectral(base, np.log)

    def f(flat: np.ndarray) -> np.ndarray:
        x = _stack(flat)
        return vectorize(root @ spectral(inverse @ x @ inverse, np.log) @ root if metric == "airm" else spectral(x, np.log) - log_base)

    return f


def tangent(m: Column, base: np.ndarray, metric: str = "airm") -> Column:
    """Tangent vectors at a base point: its whitened logarithm, or the difference of logarithms."""
    f = _tangents(base, metric)

    @F.arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        return _by_pieces(f, s)

    return run(m)


def from_tangent(v: Column, base: np.ndarray, metric: str = "airm") -> Column:
    """The matrices whose tangent vectors these are."""
    _check(metric)
    root, inverse, log_base = spectral(base, np.sqrt), spectral(base, lambda w: 1 / np.sqrt(w)), spectral(base, np.log)

    def f(v: np.ndarray) -> np.ndarray:
        t = unvectorize(v)
        x = root @ spectral(inverse @ t @ inverse, _exp, None) @ root if metric == "airm" else spectral(t + log_base, _exp, None)
        return x.reshape(len(v), -1)

    @F.arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        return _by_pieces(f, s)

    return run(v)


def distance(a: Column, b: Column, metric: str = "airm") -> Column:
    """Distance of two matrices: affine-invariant, log-Euclidean or Bures-Wasserstein."""
    if metric not in (*METRICS, "bures"):
        raise ValueError(f"unknown metric {metric}")

    def f(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        x, y = _stack(one), _stack(other)
        if metric == "log_euclidean":
            return np.sqrt(((spectral(x, np.log) - spectral(y, np.log)) ** 2).sum(axis=(1, 2)))
        if metric == "airm":
            i = spectral(x, lambda w: 1 / np.sqrt(w))
            return np.sqrt((np.log(np.maximum(np.linalg.eigvalsh(i @ y @ i), TANGENT_FLOOR)) ** 2).sum(axis=1))
        r = spectral(x, np.sqrt)
        cross = np.sqrt(np.maximum(np.linalg.eigvalsh(r @ y @ r), 0)).sum(axis=1)
        return np.sqrt(np.maximum(np.trace(x, axis1=1, axis2=2) + np.trace(y, axis1=1, axis2=2) - 2 * cross, 0))

    @F.arrow_udf("double")
    def run(s: pa.Array, t: pa.Array) -> pa.Array:
        return _by_pieces(f, s, t, kind=pa.float64())

    return run(a, b)


def _mean(rows: DataFrame, m: str, base: np.ndarray, metric: str = "airm") -> np.ndarray:
    """Mean tangent vector of a matrix column, taken and summed in the same tasks; the sums carry a 1 before each vector, so the first is the count."""
    f = _tangents(base, metric)
    counted = lambda flat: np.hstack([np.ones((len(flat), 1)), f(flat)])
    sums = cross_product(rows.select(F.array(F.lit(1.0)).alias("one"), m), "one", m, turn=counted).collect()
    found = np.array([r["v"] for r in sorted(sums, key=lambda r: r["j"])])
    return found[1:] / found[0]


def log_euclidean_mean(rows: DataFrame, m: str) -> np.ndarray:
    """exp of the mean logarithm: one pass. Null matrices don't count; raises where there is none."""
    some = rows.where(F.col(m).isNotNull()).select(F.size(m).alias("n")).first()
    if some is None:
        raise ValueError("there is no matrix to take a mean of")
    d = round(some["n"] ** 0.5)
    return spectral(unvectorize(_mean(rows, m, np.eye(d), "log_euclidean")), _exp, None)


def frechet_mean(rows: DataFrame, m: str, steps: int = 50, tol: float = 1e-6) -> np.ndarray:
    """Affine-invariant mean: from the log-Euclidean one, step along the mean tangent until it is short. One pass a step
    over the matrices, which are written down once."""
    rows = materialize(rows.select(m).where(F.col(m).isNotNull()), "matrices")
    base = log_euclidean_mean(rows, m)
    for _ in range(steps):
        t = unvectorize(_mean(rows, m, base))
        root, inverse = spectral(base, np.sqrt), spectral(base, lambda w: 1 / np.sqrt(w))
        new = root @ spectral(inverse @ t @ inverse, _exp, None) @ root
        moved = np.linalg.norm(new - base) / np.linalg.norm(base)
        base = new
        if moved < tol:
            break
    return base
