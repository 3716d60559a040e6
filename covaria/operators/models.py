"""Linear maps from X to Y fitted from sufficient statistics, chosen on validation statistics.

The sums that Stats holds are taken by Spark over all rows; what is solved here is p x q, whatever the number of rows.
Grids are ordered, and the first best wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.operators.moments import Features, Stats, linear_map, mapped

# Default grids.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
RATIOS = (1, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001)
MULTIPLIERS = (0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)


@dataclass
class Fit:
    """Coefficients p x q, intercept q, the chosen parameter and its validation score."""

    b: np.ndarray
    intercept: np.ndarray
    chosen: float
    score: float


def r2(s: Stats, b: np.ndarray, intercept: np.ndarray | float = 0.0) -> float:
    """Global R2 of xB + intercept: all cells about their grand mean, from the sums alone."""
    c = np.broadcast_to(intercept, s.sy.shape)
    sse = np.trace(s.yy) - 2 * (np.sum(b * s.xy) + c @ s.sy) + np.sum(b * (s.xx @ b)) + 2 * (s.sx @ b) @ c + s.n * c @ c
    cells = s.n * len(s.sy)
    sst = np.trace(s.yy) - s.sy.sum() ** 2 / cells
    return float(1 - sse / sst) if sst > 0 else 0.0


def column_r2(s: Stats, b: np.ndarray, intercept: np.ndarray | float = 0.0) -> np.ndarray:
    """R2 of each column of xB + intercept about its own mean, from the sums; 0 for a constant column."""
    c = np.broadcast_to(intercept, s.sy.shape)
    sse = np.diag(s.yy) - 2 * (np.sum(b * s.xy, axis=0) + c * s.sy) + np.sum(b * (s.xx @ b), axis=0) + 2 * c * (s.sx @ b) + s.n * c * c
    sst = np.diag(s.yy) - s.sy**2 / s.n
    return np.where(sst > 0, 1 - sse / np.where(sst > 0, sst, 1), 0.0)


def on_axes(s: Stats, mean: np.ndarray, axes: np.ndarray) -> Stats:
    """Statistics with y replaced by its scores (y - mean) on axes (q x k)."""
    sy = (s.sy - s.n * mean) @ axes
    yy = axes.T @ (s.yy - np.outer(mean, s.sy) - np.outer(s.sy, mean) + s.n * np.outer(mean, mean)) @ axes
    return Stats(s.n, s.sx, sy, s.xx, (s.xy - np.outer(s.sx, mean)) @ axes, yy)


def _best(val: Stats, fits: Iterable[tuple[float, np.ndarray, np.ndarray]], told: Callable[..., float] = r2) -> Fit:
    best = None
    for chosen, b, c in fits:
        score = told(val, b, c)
        if best is None or score > best.score:
            best = Fit(b, c, chosen, score)
    return best


def _with_intercept(s: Stats, b: np.ndarray) -> np.ndarray:
    return (s.sy - s.sx @ b) / s.n


def ridge(train: Stats, val: Stats, alphas: Sequence[float] = ALPHAS, told: Callable[..., float] = r2) -> Fit:
    """Ridge with a free intercept; one eigendecomposition serves all penalties, of which the best by `told` (global R2) is taken."""
    cxx, cxy, _ = train.centered()
    w, q = np.linalg.eigh(cxx)
    qty = q.T @ cxy
    solved = ((a, q @ (qty / (np.maximum(w, 0) + a)[:, None])) for a in alphas)
    return _best(val, ((a, b, _with_intercept(train, b)) for a, b in solved), told)


def truncated(b: np.ndarray, rank: int) -> np.ndarray:
    u, d, vt = np.linalg.svd(b, full_matrices=False)
    return (u[:, :rank] * d[:rank]) @ vt[:rank]


def reduced_rank(train: Stats, val: Stats, most: int = 30, alphas: Sequence[float] = ALPHAS) -> Fit:
    """The best ridge map cut to each rank up to `most`."""
    full = ridge(train, val, alphas)
    ranks = range(1, min(most, *full.b.shape) + 1)
    return _best(val, ((k, b, _with_intercept(train, b)) for k, b in ((k, truncated(full.b, k)) for k in ranks)))


def pls(train: Stats, val: Stats, components: Sequence[int] = tuple(range(1, 11)), scaled: bool = False) -> Fit:
    """Partial least squares from centred X'X and X'Y: weights are leading singular vectors of the deflated X'Y.

    scaled: standardize both blocks first, as some analyses do.
    """
    cxx, cxy, cyy = train.centered()
    dx = np.sqrt(np.diag(cxx) / train.n) if scaled else np.ones(len(cxx))
    dy = np.sqrt(np.diag(cyy) / train.n) if scaled else np.ones(len(cyy))
    dx, dy = np.where(dx > 0, dx, 1), np.where(dy > 0, dy, 1)
    sxx, left = cxx / np.outer(dx, dx), cxy / np.outer(dx, dy)
    rotations, loadings, fits = [], [], []
    for k in range(1, min(max(components), len(cxx)) + 1):
        u, d, _ = np.linalg.svd(left, full_matrices=False)
        if d[0] < 1e-12:
            break
        r = u[:, 0] - sum((p @ u[:, 0]) * v for p, v in zip(loadings, rotations, strict=True)) if rotations else u[:, 0]
        scale = r @ sxx @ r
        if scale < 1e-12:
            break
        p = sxx @ r / scale
        rotations.append(r)
        loadings.append(p)
        left = left - np.outer(p, r @ left)
        if k in components:
            m = np.array(rotations).T
            q = np.linalg.solve(m.T @ sxx @ m, m.T @ (cxy / np.outer(dx, dy)))
            b = (m @ q) / dx[:, None] * dy
            fits.append((k, b, _with_intercept(train, b)))
    return _best(val, fits)


def soft_threshold(b: np.ndarray, t: float) -> np.ndarray:
    """Singular values less t, none below 0."""
    u, d, vt = np.linalg.svd(b, full_matrices=False)
    return (u * np.maximum(d - t, 0)) @ vt


def nuclear_norm(train: Stats, val: Stats, ratios: Sequence[float] = RATIOS, steps: int = 2000, tol: float = 1e-6) -> Fit:
    """Proximal gradient on |Y - XB|^2 / 2n + l |B|_*, warm from large to small l; l is a ratio of X'Y / n's largest singular value."""
    xx, xy = train.xx / train.n, train.xy / train.n
    step = 1 / (np.linalg.eigvalsh(xx)[-1] + 1e-10)
    most = np.linalg.norm(xy, 2)

    def path() -> Iterable[tuple[float, np.ndarray, np.ndarray]]:
        b = np.zeros_like(xy)
        for ratio in sorted(ratios, reverse=True):
            for _ in range(steps):
                new = soft_threshold(b - step * (xx @ b - xy), step * ratio * most)
                moved = np.linalg.norm(new - b) / (np.linalg.norm(new) + 1e-15)
                b = new
                if moved < tol:
                    break
            yield ratio, b, np.zeros(b.shape[1])

    return _best(val, path())


def noise_median(beta: float, cells: int = 20_001) -> float:
    """Median of the Marchenko-Pastur law of aspect beta (0 < beta <= 1), by summing its density."""
    lo, hi = (1 - beta**0.5) ** 2, (1 + beta**0.5) ** 2
    t = np.linspace(0, np.pi, cells)
    x = (lo + hi) / 2 - (hi - lo) / 2 * np.cos(t)  # dense at both ends
    density = np.sqrt(np.maximum((hi - x) * (x - lo), 0)) / (2 * np.pi * beta * np.maximum(x, 1e-300)) * (hi - lo) / 2 * np.sin(t)
    mass = np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(t))
    return float(np.interp(mass[-1] / 2, mass, x[1:]))


def shrunk(b: np.ndarray, multiplier: float = 1.0, hard: bool = False) -> np.ndarray:
    """Singular values shrunk for white noise whose level their median tells; hard: kept as they are above the edge."""
    u, d, vt = np.linalg.svd(b, full_matrices=False)
    beta = min(b.shape) / max(b.shape)
    sigma = max(float(np.median(d)) / noise_median(beta) ** 0.5, 1e-10) * multiplier
    lo, hi = (1 - beta**0.5) ** 2, (1 + beta**0.5) ** 2
    above = d > hi**0.5 * sigma
    soft = np.sqrt(np.maximum((d**2 - hi * sigma**2) * (d**2 - lo * sigma**2), 0)) / np.maximum(d, 1e-300)
    return (u * np.where(above, d if hard else soft, 0)) @ vt


def optimal_shrinkage(train: Stats, val: Stats, alphas: Sequence[float] = ALPHAS, multipliers: Sequence[float] = MULTIPLIERS, hard: bool = False) -> Fit:
    """Ridge of each penalty, shrunk with each multiple of the noise level; the best of the grid."""
    fits = []
    for a in alphas:
        b = ridge(train, val, [a]).b
        fits += [(a + 1j * m, s, _with_intercept(train, s)) for m, s in ((m, shrunk(b, m, hard)) for m in multipliers)]
    best = _best(val, fits)
    return Fit(best.b, best.intercept, float(np.real(best.chosen)), best.score)


METHODS = {"ridge": ridge, "rrr": reduced_rank, "pls": pls, "nuclear_norm": nuclear_norm, "linear_optshrink": optimal_shrinkage}


def fit(method: str, train: Stats, val: Stats, **options) -> Fit:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    return METHODS[method](train, val, **options)


def predict(rows: DataFrame, x: str, fitted: Fit, name: str = "prediction") -> DataFrame:
    """Add xB + intercept; coefficients are broadcast as a matrix."""
    return linear_map(rows, x, fitted.b, fitted.intercept, name)


def components(train: Stats, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading k principal axes (q x k) of Y; at most n and q of them, each with its largest part positive."""
    _, _, cyy = train.centered()
    k = int(min(k, len(cyy), train.n))
    v = np.linalg.eigh(cyy)[1][:, ::-1][:, :k]
    return train.sy / train.n, v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])


def component_r2(s: Stats, fitted: Fit, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """R2 of each component score on the rows of s, from the sums; scores not finite count 0."""
    out = []
    for v in axes.T:
        b, c, m = fitted.b @ v, fitted.intercept @ v, mean @ v
        yy, y = v @ s.yy @ v - 2 * m * (s.sy @ v) + s.n * m * m, s.sy @ v - s.n * m
        c0 = c - m
        cross = b @ (s.xy @ v) - m * (s.sx @ b) + c0 * y
        pp = b @ s.xx @ b + 2 * c0 * (s.sx @ b) + s.n * c0 * c0
        sst = yy - y * y / s.n
        out.append(1 - (yy - 2 * cross + pp) / sst if sst > 0 else 0.0)
    return np.nan_to_num(np.array(out), nan=0.0, posinf=0.0, neginf=0.0)


def fourier(rows: DataFrame, x: str, d: int, bandwidth: float, seed: int = 0) -> Features:
    """sqrt(2 / d) cos(xW + b), random Fourier features of a Gaussian kernel; W and b come from the seed and are broadcast."""
    p = rows.select(F.size(x).alias("p")).first()["p"]
    rng = np.random.default_rng(seed)
    sent = rows.sparkSession.sparkContext.broadcast((rng.standard_normal((p, d)) / bandwidth, rng.uniform(0, 2 * np.pi, d)))

    def f(block: np.ndarray) -> np.ndarray:
        w, b = sent.value
        return np.cos(block @ w + b) * (2 / d) ** 0.5

    return Features(p, d, f)


def fourier_features(rows: DataFrame, x: str, d: int, bandwidth: float, seed: int = 0, name: str = "phi") -> DataFrame:
    """Add random Fourier features; where only their sums are asked for, stats_by makes them as it multiplies."""
    return mapped(rows, x, fourier(rows, x, d, bandwidth, seed).f, name)


# Bandwidths by the median one, penalties and soft thresholds of the kernel spectral grid.
BANDWIDTHS = (0.5, 1.0, 2.0)
KERNEL_ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
THRESHOLDS = (0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)


def soft_thresholded(val: Stats, train: Stats, b: np.ndarray, ratios: Sequence[float] = THRESHOLDS) -> Fit:
    """A map with its singular values less a share of the largest; the best share on validation rows."""
    top = np.linalg.norm(b, 2)
    return _best(val, ((r, c, _with_intercept(train, c)) for r, c in ((r, soft_threshold(b, r * top)) for r in ratios)))


@dataclass
class KernelFit:
    """A map on random Fourier features, the bandwidth by the median one, the ridge penalty, and the shrinkage chosen."""

    fit: Fit
    bandwidth: float
    alpha: float
    shrinkage: float


def kernel_spectral(by: dict[float, tuple[Stats, Stats]], alphas: Sequence[float] = KERNEL_ALPHAS, multipliers: Sequence[float] = MULTIPLIERS) -> dict[str, KernelFit]:
    """The best maps on Fourier features by validation R2: `shrunk` for white noise and `soft` thresholded.

    by: training and validation statistics of the features at each bandwidth. Shrinkage is searched over bandwidths, penalties and
    multiples of the noise level together; soft thresholds at the bandwidth and penalty that are best without any.
    """
    best: dict[str, KernelFit] = {}

    def offer(name: str, found: KernelFit) -> None:
        if name not in best or found.fit.score > best[name].fit.score:
            best[name] = found

    for width, (train, val) in by.items():
        for alpha in alphas:
            plain = ridge(train, val, [alpha])
            offer("plain", KernelFit(plain, width, alpha, 0.0))
            tried = _best(val, ((m, s, _with_intercept(train, s)) for m, s in ((m, shrunk(plain.b, m)) for m in multipliers)))
            offer("shrunk", KernelFit(tried, width, alpha, float(tried.chosen)))
    if "plain" in best:
        p = best["plain"]
        train, val = by[p.bandwidth]
        soft = soft_thresholded(val, train, p.fit.b)
        best["soft"] = KernelFit(soft, p.bandwidth, p.alpha, float(soft.chosen))
    return best
