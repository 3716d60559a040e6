"""Sums of several blocks at once, and what follows from them without another pass.

The sums are those of u = [1, blocks ...] times itself. A block derived linearly from others (centred, scaled, residualized on
covariates, projected on axes) is a matrix of weights W with u W as its values, so its sums are W' M W: training
coefficients, and all that is fitted and told after them, are solved on matrices of features by features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.operators import models, moments

# Penalties of the residualization sweep.
SWEEP_ALPHAS = (1e-3, 1e-2, 1e-1, 1, 10, 100)


@dataclass
class Blocks:
    """Sums of [1, blocks ...] times itself, and where each block lies."""

    m: np.ndarray
    at: dict[str, slice]

    @property
    def n(self) -> float:
        return float(self.m[0, 0])

    def weights(self, *names: str) -> np.ndarray:
        """Weights that pick blocks as they are; "1" is the constant."""
        eye = np.eye(len(self.m))
        return np.hstack([eye[:, :1] if n == "1" else eye[:, self.at[n]] for n in names])

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.T @ self.m @ b

    def sums(self, w: np.ndarray) -> np.ndarray:
        return self.m[0] @ w

    def stats(self, x: np.ndarray, y: np.ndarray) -> moments.Stats:
        """Statistics of two derived blocks."""
        return moments.Stats(self.n, self.sums(x), self.sums(y), self.products(x, x), self.products(x, y), self.products(y, y))

    def coefficients(self, w: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Least squares of a derived block on another, of least norm where that one's columns are dependent."""
        gram = self.products(on, on)
        size = np.sqrt(np.maximum(np.diag(gram), 1e-300))  # columns of one length: ages and constants differ much
        return np.linalg.pinv(gram / np.outer(size, size), rcond=1e-12, hermitian=True) @ (self.products(on, w) / size[:, None]) / size[:, None]

    def residual(self, w: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Weights of a block less what another one explains in these rows."""
        return w - on @ self.coefficients(w, on)

    def centered(self, w: np.ndarray) -> np.ndarray:
        return w - np.outer(self.weights("1")[:, 0], self.sums(w) / self.n)

    def scaled(self, w: np.ndarray, eps: float = 0.0) -> np.ndarray:
        """Weights of a block less its mean in these rows, by its deviation (ddof 0) plus eps."""
        c = self.centered(w)
        sd = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", c, self.m, c) / self.n, 0)) + eps
        return c / np.where(sd > 0, sd, 1)

    def __add__(self, other: Blocks) -> Blocks:
        return Blocks(self.m + other.m, self.at)


def sums_by(rows: DataFrame, names: Sequence[str], keys: Sequence[str] = (), weight: str | None = None) -> dict[tuple, Blocks]:
    """Blocks of array columns for each group of keys, from one pass; rows with a null block don't count."""
    known = rows.where(" AND ".join(f"`{n}` IS NOT NULL" for n in names))
    ends = [F.size(F.concat(*[F.col(n) for n in names[: k + 1]])).alias(f"_e{k}") for k in range(len(names))]
    joined = known.select(*keys, *ends, F.concat(*[F.col(n).cast("array<double>") for n in names]).alias("_all"), *([weight] if weight else []))
    lone = F.array().cast("array<double>")
    places = [f"_e{k}" for k in range(len(names))]
    found = moments.stats_by(joined.withColumn("_none", lone), "_all", "_none", [*keys, *places], weight)
    out = {}
    for key, s in found.items():
        cuts = [1, *(1 + e for e in key[len(keys) :])]
        m = np.block([[np.array([[s.n]]), s.sx[None]], [s.sx[:, None], s.xx]])
        out[key[: len(keys)]] = Blocks(m, {n: slice(a, b) for n, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)})
    return out


def sweep(
    by: dict[str, Blocks], subsets: dict[str, Sequence[int] | None], ks: Sequence[int] = (5, 10, 20), eval_k: int = 20, alphas: Sequence[float] = SWEEP_ALPHAS,
    x: str = "x", y: str = "y", covariates: str = "c", eps: float = 1e-8,
) -> list[dict]:
    """How accuracy depends on what was residualized: (mode, model_k, alpha, dataset, pc_r2, edge_r2) for each subset of covariates.

    by: sums by dataset, of which "train" and "val" are needed; the others are told. Blocks are residualized on a constant and
    the subset (None: not at all) by training coefficients, standardized by training moments, and mapped by ridge on the
    leading k components of y, with the penalty of the best mean R2 of components on "val". Subsets cost no pass over rows.
    """
    train = by["train"]
    out = []
    for mode, subset in subsets.items():
        wx, wy = train.weights(x), train.weights(y)
        if subset is not None:
            on = train.weights("1", covariates)[:, [0, *(1 + c for c in subset)]]
            wx, wy = train.residual(wx, on), train.residual(wy, on)
        wx, wy = train.scaled(wx, eps), train.scaled(wy, eps)
        stats = {name: b.stats(wx, wy) for name, b in by.items()}
        mean, axes = models.components(stats["train"], eval_k)
        for k in ks:
            center, some = models.components(stats["train"], k)
            onto = lambda s: models.on_axes(s, center, some)  # noqa: B023, E731
            fit = models.ridge(onto(stats["train"]), onto(stats["val"]), alphas, lambda s, b, c: float(models.column_r2(s, b, c).mean()))
            full = models.Fit(fit.b @ some.T, fit.intercept @ some.T + center, fit.chosen, fit.score)
            for name, s in stats.items():
                if name not in ("train", "val"):
                    pcs, edges = models.component_r2(s, full, mean, axes).mean(), models.column_r2(s, full.b, full.intercept).mean()
                    out.append({"mode": mode, "model_k": int(k), "alpha": float(fit.chosen), "dataset": name, "pc_r2": float(pcs), "edge_r2": float(edges)})
    return out
