"""Analyses of a fitted map: what its subspace leaves behind, what controls alone give, where its modes lie.

Everything but kernel features and predictions follows from sums of products; passes over rows are named in each docstring.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.functions import vectors as V
from covaria.operators import geometry, inference, models, moments
from covaria.operators.moments import Stats
from covaria.operators.splits import draw
from covaria.sources.scratch import materialize

#: Landmarks of a kernel, at most: what is solved is landmarks by landmarks, on the driver.
MOST_LANDMARKS = 2000


def left_subspace(b: np.ndarray, k: int) -> np.ndarray:
    """Leading k left singular vectors (p x k) of a map."""
    return np.linalg.svd(b, full_matrices=False)[0][:, :k]


def plus(stats: Sequence[Stats]) -> Stats:
    """Statistics of all rows from those of disjoint groups."""
    return Stats(*(sum(getattr(s, f) for s in stats) for f in ("n", "sx", "sy", "xx", "xy", "yy")))


def rank_sweep(s: Stats, u: np.ndarray, ranks: Sequence[int]) -> list[dict]:
    """(r, coupled, uncoupled): shares of x's energy inside and outside the leading r columns of u. No pass."""
    total = np.trace(s.xx)
    inside = [float(np.trace(u[:, :r].T @ s.xx @ u[:, :r]) / total) for r in ranks]
    return [{"r": int(r), "coupled": c, "uncoupled": 1 - c} for r, c in zip(ranks, inside, strict=True)]


def feature_shares(s: Stats, u: np.ndarray) -> np.ndarray:
    """Of each feature of x, the variance of its projection on u's span by its own; 0 for a constant one. No pass."""
    cxx = s.centered()[0]
    p = u @ u.T
    own = np.diag(cxx)
    return np.where(own > 1e-12 * s.n, np.diag(p @ cxx @ p) / np.where(own > 0, own, 1), 0.0)


def group_shares(share: np.ndarray, groups: Sequence[str]) -> list[dict]:
    """(grp, n, mean, sd) of features' shares by their group; sd has ddof 1, and is null for one feature."""
    names = np.array(groups)
    mine = {g: share[names == g] for g in sorted(set(groups))}
    return [{"grp": g, "n": len(v), "mean": float(v.mean()), "sd": float(v.std(ddof=1)) if len(v) > 1 else None} for g, v in mine.items()]


def stability(maps: dict[str, np.ndarray], r: int) -> list[dict]:
    """(a, b, mean_angle, max_angle, min_angle, mean_cos): principal angles in degrees between maps' leading left subspaces."""
    u = {name: left_subspace(b, r) for name, b in maps.items()}
    angles = {(a, b): geometry.principal_angles(u[a], u[b]) for a, b in combinations(u, 2)}
    return [{"a": a, "b": b, "mean_angle": float(v.mean()), "max_angle": float(v.max()), "min_angle": float(v.min()), "mean_cos": float(np.cos(np.radians(v)).mean())} for (a, b), v in angles.items()]


def landmarks(rows: DataFrame, key: str, x: str, m: int, seed: int = 42) -> np.ndarray:
    """Blocks of m rows, the first by a hash of key and seed: a bounded sample that stands for the kernel's centres."""
    if not 0 < m <= MOST_LANDMARKS:
        raise ValueError(f"landmarks are 1 to {MOST_LANDMARKS}")
    taken = rows.where(F.col(x).isNotNull()).select(draw(F.col(key), seed).alias("h"), F.col(x).cast("array<double>").alias("x")).orderBy("h", "x").limit(m).collect()
    return np.array([r["x"] for r in taken])


def width_of(centres: np.ndarray) -> float:
    """1 / (2 d^2) for the median distance d of different landmarks; 0.001 without one."""
    sq = (centres**2).sum(axis=1)
    d2 = np.maximum(sq[:, None] + sq - 2 * centres @ centres.T, 0)
    d = np.sqrt(d2[d2 > 1e-12 * max(1.0, sq.max(initial=0))])
    return float(1 / (2 * np.median(d) ** 2)) if len(d) else 1e-3


def kernel_features(rows: DataFrame, x: str, centres: np.ndarray, gamma: float, name: str = "phi") -> DataFrame:
    """Add k(x, centres) K^(-1/2): Nystrom features of a Gaussian kernel, whose products are the kernel's on the landmarks' span.

    With every row a landmark they are the kernel's own. Each task maps its batches; the broadcast is landmarks by landmarks.
    """
    sq = (centres**2).sum(axis=1)
    k = np.exp(-gamma * np.maximum(sq[:, None] + sq - 2 * centres @ centres.T, 0))
    w, q = np.linalg.eigh(k)
    keep = w > 1e-12 * w[-1]
    root = q[:, keep] / np.sqrt(w[keep])

    def f(block: np.ndarray, centres: np.ndarray, root: np.ndarray) -> np.ndarray:
        far = (block**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * block @ centres.T
        return np.exp(-gamma * np.maximum(far, 0)) @ root

    return moments.mapped(rows, x, f, name, centres, root)


def _solved(s: Stats, alpha: float) -> np.ndarray:
    """Ridge without an intercept."""
    return np.linalg.solve(s.xx + alpha * np.eye(len(s.xx)), s.xy)


def nonlinear_residual(
    train: DataFrame, test: DataFrame, key: str, x: str, y: str, u: np.ndarray, m: int = 500, alpha: float = 1.0, replicates: int = 200, seed: int = 42,
) -> DataFrame:
    """One row: does the part of x outside u's span tell y by a kernel? r2_linear, r2_kernel, gamma, null_mean, null_sd, null_p95, p, n_null.

    Test R2 (the mean over columns) of ridge and of kernel ridge on m landmarks, both on x less its projection; the null permutes
    training rows of the residual block, for which only features' products with y are summed again. p is the share of the null
    at or above the observed value.
    """
    rest = np.eye(len(u)) - u @ u.T
    known = [d.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y) for d in (train, test)]
    left = [materialize(moments.linear_map(d, x, rest, name="rest"), "residual") for d in known]
    linear, told = (moments.stats(d, "rest", y) for d in left)
    b = models.ridge(linear, linear, [alpha])
    centres = landmarks(left[0], key, "rest", m, seed)
    gamma = width_of(centres)
    learn, seen = (kernel_features(d, "rest", centres, gamma) for d in left)
    base, held = (moments.stats(d, "phi", y) for d in (learn, seen))
    r2 = lambda s: float(models.column_r2(held, _solved(s, alpha)).mean())
    observed = r2(base)
    null = inference.by_products(inference.resampled_products(learn, key, "phi", y, replicates, seed, "break"), lambda by: [{"r2": r2(replace(base, xy=by[()].xy))}], "r2 double")
    v = F.col("r2")
    return null.agg(
        F.lit(float(models.column_r2(told, b.b, b.intercept).mean())).alias("r2_linear"), F.lit(observed).alias("r2_kernel"), F.lit(gamma).alias("gamma"), F.avg(v).alias("null_mean"), F.stddev_pop(v).alias("null_sd"),
        F.percentile(v, 0.95).alias("null_p95"), (F.count_if(v >= observed) / F.count(v)).alias("p"), F.count(v).alias("n_null"),
    )


def prediction_overlap(s: Stats, b: np.ndarray, k: int) -> float:
    """Overlap of the leading k right subspaces of y and of x b, from the sums."""
    a, p = (np.linalg.eigh(m)[1][:, ::-1][:, :k] for m in (s.yy, b.T @ s.xx @ b))
    return geometry.overlap(a, p)


def dissociation(spark: SparkSession, test: Stats, fits: dict[str, models.Fit], ks: Sequence[int], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(method, k, overlap, r2, ratio, effective_rank, null_mean, p): subspaces recovered against variance explained, per map.

    The null has random subspaces against y's own; p counts one more on both sides. ratio is overlap by R2, the latter at
    least 1e-10. No pass over rows.
    """
    out = []
    for k in ks:
        axes = np.linalg.eigh(test.yy)[1][:, ::-1][:, :k]
        seen = {m: prediction_overlap(test, f.b, k) for m, f in fits.items()}
        null, v = inference.haar_null(spark, axes, k, replicates, seed), F.col("overlap")
        told = null.agg(F.avg(v).alias("mean"), *[inference.p_value(v, o).alias(f"p{i}") for i, o in enumerate(seen.values())]).first()
        for i, (m, f) in enumerate(fits.items()):
            r2 = models.r2(test, f.b, f.intercept)
            out.append((m, int(k), seen[m], r2, seen[m] / max(r2, 1e-10), int((np.linalg.svd(f.b, compute_uv=False) > 1e-10).sum()), told["mean"], told[f"p{i}"]))
    return spark.createDataFrame(out, "method string, k long, overlap double, r2 double, ratio double, effective_rank long, null_mean double, p double")


def controls_refit(by: dict[tuple[str, bool], Stats], ks: Sequence[int], method: str = "nuclear_norm", **options) -> list[dict]:
    """(k, measure, value) of a map fitted to controls beside the one fitted to everybody; splits are train, val and test.

    by: statistics of (split, is control) from one pass; everybody's are the sum of both groups'. Told are each map's R2 and mean
    component R2 on the controls' test rows and on all of them (components of the controls' training rows), overlap of predicted
    and true subspaces, overlap of the two maps' right subspaces, and ranks (k = 0).
    """
    control = {s: by[s, True] for s in ("train", "val", "test")}
    everyone = {s: plus([v for (split, _), v in by.items() if split == s]) for s in ("train", "val", "test")}
    fits = {name: models.fit(method, d["train"], d["val"], **options) for name, d in (("controls", control), ("mixed", everyone))}
    rank = {name: int((np.linalg.svd(f.b, compute_uv=False) > 1e-10).sum()) for name, f in fits.items()}
    out = [{"k": 0, "measure": f"rank_{name}", "value": float(r)} for name, r in rank.items()]
    for where, s in (("controls", control["test"]), ("everyone", everyone["test"])):
        out += [{"k": 0, "measure": f"r2_{name}_on_{where}", "value": models.r2(s, f.b, f.intercept)} for name, f in fits.items()]
        for k in ks:
            mean, axes = models.components(control["train"], k)
            out += [{"k": int(k), "measure": f"pc_r2_{name}_on_{where}", "value": float(models.component_r2(s, f, mean, axes).mean())} for name, f in fits.items()]
            out += [{"k": int(k), "measure": f"overlap_{name}_on_{where}", "value": prediction_overlap(s, f.b, k)} for name, f in fits.items()]
    for k in ks:
        r = min(k, *rank.values())
        v = [geometry.right_subspace(f.b, r) for f in fits.values()]
        out.append({"k": int(k), "measure": "overlap_of_maps", "value": geometry.overlap(*v)})
    return out


def mode_positions(b: np.ndarray, gradient: np.ndarray, modes: int = 3) -> np.ndarray:
    """Where a map's modes lie along a gradient of x's features: its mean weighted by the size of their left vectors' entries."""
    u = np.abs(left_subspace(b, modes))
    return (u * np.asarray(gradient)[:, None]).sum(axis=0) / u.sum(axis=0)


def theory(train: Stats, test: Stats, fitted: models.Fit, r: int = 20) -> dict:
    """Spiked-model plug-ins beside what is observed: gamma, edge, n_recovered, overlap and R2 of both kinds.

    Noise is the mean squared residual on the test rows, gamma is x's features by training rows. No pass over rows.
    """
    u, d, _ = np.linalg.svd(fitted.b, full_matrices=False)
    r = min(r, len(d))
    q = len(test.sy)
    c = np.broadcast_to(fitted.intercept, test.sy.shape)
    b = fitted.b
    sse = np.trace(test.yy) - 2 * (np.sum(b * test.xy) + c @ test.sy) + np.sum(b * (test.xx @ b)) + 2 * (test.sx @ b) @ c + test.n * c @ c
    noise2 = float(sse / (test.n * q))
    gamma = len(u) / train.n
    variance = np.diag(u[:, :r].T @ train.centered()[0] @ u[:, :r]) / train.n
    told = {
        "r": r, "gamma": gamma, "edge": gamma**0.25, "noise2": noise2, "n_recovered": int((d[:r] / noise2**0.5 > gamma**0.25).sum()), "overlap_theory": geometry.spiked_overlap(d[:r], noise2**0.5, gamma),
        "overlap_observed": prediction_overlap(test, b, r), "r2_theory": geometry.spiked_r2(d[:r], variance, q, noise2), "r2_observed": models.r2(test, b, fitted.intercept),
    }
    return {k: v if isinstance(v, int) else float(v) for k, v in told.items()}


def position_intervals(rows: DataFrame, key: str, x: str, y: str, gradient: np.ndarray, modes: int = 3, replicates: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(mode, position, lo, hi): modes of the cross-covariance along a gradient, with percentiles over bootstraps of rows."""
    products = inference.resampled_products(rows, key, x, y, replicates, seed, "bootstrap", observed=True)
    one = lambda by: [{"mode": i + 1, "position": float(v)} for i, v in enumerate(mode_positions(by[()].covariance(), gradient, modes))]
    told = inference.by_products(products, one, "mode long, position double")
    a = (1 - level) / 2
    ends = told.where("rep >= 0").groupBy("mode").agg(F.percentile("position", a).alias("lo"), F.percentile("position", 1 - a).alias("hi"))
    return told.where("rep < 0").drop("rep").join(ends, "mode")


def prediction_targets(summary: DataFrame, key: str, states: int, eps: float = 1e-6) -> tuple[DataFrame, dict[str, list[int]]]:
    """(key, y) of subjects' dynamics as numbers for regression, and where each group of targets lies in y.

    From the columns of dynamics.subject_summary: occupancy as centred log-ratios, ln(1 + .) of dwell, energy, switching rate and
    entropy, and each row of the transition matrix as centred log-ratios. Two bundles join the slow and the fast ones.
    """
    k = range(states)
    occupancy = V.clr(F.array(*[F.col(f"occ_{i}") for i in k]), eps)
    logs = lambda names: F.array(*[F.log1p(F.col(n)) for n in names])
    rows = [V.clr(F.array(*[F.col(f"tp_{i}_{j}") for j in k]), eps) for i in k]
    parts = {
        "occupancy": (occupancy, states), "dwell": (logs([f"dwell_{i}" for i in k]), states), "energy": (logs([f"energy_{i}" for i in k]), states), "switching_rate": (logs(["switching_rate"]), 1),
        "transition_entropy": (logs(["transition_entropy"]), 1), "transition_matrix": (F.concat(*rows), states * states),
    }
    groups, at = {}, 0
    for name, (_, n) in parts.items():
        groups[name], at = list(range(at, at + n)), at + n
    groups["slow_bundle"] = groups["occupancy"] + groups["dwell"] + groups["energy"]
    groups["fast_bundle"] = groups["switching_rate"] + groups["transition_entropy"] + groups["transition_matrix"]
    return summary.select(key, F.concat(*[c for c, _ in parts.values()]).alias("y")), groups


def columns_of(s: Stats, at: Sequence[int]) -> Stats:
    """Statistics with some of y's columns."""
    at = list(at)
    return Stats(s.n, s.sx, s.sy[at], s.xx, s.xy[:, at], s.yy[np.ix_(at, at)])


def regression_summary(s: Stats, b: np.ndarray, intercept: np.ndarray) -> dict:
    """r2_mean, r2_median, corr_mean, corr_median, slope, n_targets of x b + intercept on the rows of s, from the sums.

    Columns that don't vary don't count; a prediction that doesn't vary has correlation 0; slope is that of all cells of truth on
    all cells of prediction, 0 where these are constant.
    """
    cxx, cxy, cyy = s.centered()
    vary = np.diag(cyy) / s.n > 1e-24
    told = np.einsum("ij,ik,kj->j", b, cxx, b)
    both = np.sum(b * cxy, axis=0)
    corr = np.where(told / s.n > 1e-24, both / np.sqrt(np.maximum(told * np.diag(cyy), 1e-300)), 0.0)[vary]
    r2 = models.column_r2(s, b, intercept)[vary]
    c = np.broadcast_to(intercept, s.sy.shape)
    p, cells = s.sx @ b + s.n * c, s.n * len(s.sy)
    pp = np.sum(b * (s.xx @ b)) + 2 * c @ (s.sx @ b) + s.n * c @ c - p.sum() ** 2 / cells
    py = np.sum(b * s.xy) + c @ s.sy - p.sum() * s.sy.sum() / cells
    mean = lambda f, v: float(f(v)) if len(v) else None
    return {"r2_mean": mean(np.mean, r2), "r2_median": mean(np.median, r2), "corr_mean": mean(np.mean, corr), "corr_median": mean(np.median, corr), "slope": float(py / pp) if pp / cells > 1e-24 else 0.0, "n_targets": len(s.sy)}


def prediction_suite(by: dict[str, Stats], groups: dict[str, Sequence[int]], alphas: Sequence[float] = models.ALPHAS) -> list[dict]:
    """(target, dataset, alpha, and the summary) of ridge maps to each group of targets, penalties chosen on "val".

    by: statistics by dataset from one pass over all targets; those beside "train" and "val" are told. Groups cost no pass.
    """
    out = []
    for name, at in groups.items():
        mine = {d: columns_of(s, at) for d, s in by.items()}
        fit = models.ridge(mine["train"], mine["val"], alphas)
        out += [{"target": name, "dataset": d, "alpha": float(fit.chosen), **regression_summary(s, fit.b, fit.intercept)} for d, s in mine.items() if d not in ("train", "val")]
    return out


def estimator_ranks(s: Stats, ratio: float, alphas: Sequence[float] = (1.0, 10.0, 100.0), steps: int = 2000) -> list[dict]:
    """(estimator, effective_rank, max_gap, gap_after): does a map's rank come from its estimator? Nuclear norm, ridge and least squares.

    All are fitted to the same centred sums; max_gap is the largest fall of log10 singular values and gap_after the place (from 0)
    that it follows. Singular values at or below 1e-300 count as that.
    """
    cxx, cxy, _ = s.centered()
    centred = Stats(s.n, s.sx * 0, s.sy * 0, cxx, cxy, np.zeros((len(s.sy), len(s.sy))))
    maps = {f"nuclear_norm_{ratio:g}": models.nuclear_norm(centred, centred, [ratio], steps).b}
    maps |= {f"ridge_{a:g}": np.linalg.solve(cxx + a * np.eye(len(cxx)), cxy) for a in alphas}
    maps["ols"] = np.linalg.pinv(cxx, hermitian=True) @ cxy
    out = []
    for name, b in maps.items():
        d = np.linalg.svd(b, compute_uv=False)
        gaps = -np.diff(np.log10(np.maximum(d, 1e-300)))
        at = int(np.argmax(gaps)) if len(gaps) else 0
        out.append({"estimator": name, "effective_rank": geometry.effective_rank(d), "max_gap": float(gaps[at]) if len(gaps) else 0.0, "gap_after": at})
    return out
