"""Regression of symmetric positive definite matrices in the tangent space of their mean.

Training matrices give a mean (Frechet or log-Euclidean); matrices become tangent vectors at it, covariates are
residualized there by training coefficients, and a nuclear-norm map from x is chosen on validation rows. Predictions
take the covariates' part back and return along the exponential map, so they are matrices again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.functions import vectors as V
from covaria.operators import blocks, geometry, models, moments, spd
from covaria.sources.scratch import materialize


@dataclass
class TangentFit:
    """A mean and the map from [x, covariates] to tangent vectors there: offset + x b + covariates beta."""

    base: np.ndarray
    metric: str
    b: np.ndarray
    offset: np.ndarray
    beta: np.ndarray | None
    chosen: float
    val_mse: float | None

    def effective_rank(self, eps: float = 1e-4) -> int:
        return geometry.effective_rank(np.linalg.svd(self.b, compute_uv=False), eps)

    def modes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular value decomposition of the map."""
        return np.linalg.svd(self.b, full_matrices=False)


def fit(
    rows: DataFrame, m: str, x: str, split: str, covariates: str | None = None, metric: str = "airm", ratios: Sequence[float] = models.RATIOS, steps: int = 2000, tol: float = 1e-6,
) -> TangentFit:
    """Fit on split = 'train'; the penalty (a ratio of the largest that leaves anything) is the best by error on 'val'.

    Without rows of 'val' the middle ratio is taken. Rows with a null among m, x and covariates don't count. The mean takes a
    pass for each step of its descent over the training matrices, all else one pass; what is solved is features by features.
    """
    names = [m, x, *([covariates] if covariates else [])]
    whole = rows.where(" AND ".join(f"`{n}` IS NOT NULL" for n in names)).where(F.col(split).isin("train", "val"))
    known = materialize(whole.select(split, *names), "tangent")
    learn = known.where(F.col(split) == "train")
    base = spd.frechet_mean(learn, m) if metric == "airm" else spd.log_euclidean_mean(learn, m)
    used = ["_t", x, *([covariates] if covariates else [])]
    by = blocks.sums_by(known.withColumn("_t", spd.tangent(F.col(m), base, metric)), used, [split])
    train = by["train",]
    wt, beta = train.weights("_t"), None
    if covariates:
        on = train.weights("1", covariates)
        beta = train.coefficients(wt, on)
        wt = wt - on @ beta
    # both blocks less their training means, so the map has no intercept of its own
    mean_x, mean_t = train.sums(train.weights(x)) / train.n, train.sums(wt) / train.n
    wx, wt = train.centered(train.weights(x)), train.centered(wt)
    s = train.stats(wx, wt)
    v = by["val",].stats(wx, wt) if ("val",) in by else None
    ordered = sorted(ratios, reverse=True)
    found = models.nuclear_norm(s, v or s, ordered if v else [ordered[len(ordered) // 2]], steps, tol)
    mse = float((np.trace(v.yy) - 2 * np.sum(found.b * v.xy) + np.sum(found.b * (v.xx @ found.b))) / (v.n * len(v.sy))) if v else None
    offset = mean_t - mean_x @ found.b + (beta[0] if beta is not None else 0)
    return TangentFit(base, metric, found.b, offset, beta[1:] if beta is not None else None, found.chosen, mse)


def predict(rows: DataFrame, fitted: TangentFit, x: str, covariates: str | None = None, name: str = "predicted", strict: bool = False) -> DataFrame:
    """Add the predicted matrix (row-major). strict: what x explains alone, covariates held at zero."""
    if fitted.beta is None or strict:
        mapped = moments.linear_map(rows, x, fitted.b, fitted.offset, "_tangent")
    elif covariates is None:
        raise ValueError("the fit has covariates, so predictions need them")
    else:
        both = rows.withColumn("_both", F.concat(F.col(x).cast("array<double>"), F.col(covariates).cast("array<double>")))
        mapped = moments.linear_map(both, "_both", np.vstack([fitted.b, fitted.beta]), fitted.offset, "_tangent").drop("_both")
    return mapped.withColumn(name, spd.from_tangent(F.col("_tangent"), fitted.base, fitted.metric)).drop("_tangent")


def edges_of(m: Column, d: int) -> Column:
    """Upper triangle of a predicted matrix as Fisher z."""
    return V.fisher_z(V.upper_triangle(m, d))


def evaluate(rows: DataFrame, edges: str, truth: str, predicted: str, split: str, d: int, ks: Sequence[int] = (5, 10, 20)) -> list[dict]:
    """(split, measure, value): accuracy of predicted matrices on every split.

    Edge and component R2 are told of the edges as predicted and after a linear calibration of each edge on the training
    rows; components are those of the training truth. Distances are means and deviations (ddof 0) over rows.
    """
    known = materialize(rows.select(split, F.col(edges).cast("array<double>").alias("y"), edges_of(F.col(predicted), d).alias("p"), F.col(truth).alias("m"), F.col(predicted).alias("f")), "evaluated")
    by = blocks.sums_by(known, ["y", "p"], [split])
    train = by["train",]
    wy, wp = train.weights("y"), train.weights("p")
    s = train.stats(wp, wy)
    cxx, cxy, _ = s.centered()
    slope = np.diag(cxy) / (np.diag(cxx) + 1e-12 * s.n)
    fits = {"": (np.eye(len(slope)), np.zeros(len(slope))), "calibrated_": (np.diag(slope), (s.sy - slope * s.sx) / s.n)}
    out = []
    for (name,), b in by.items():
        here = b.stats(wp, wy)
        for kind, (matrix, offset) in fits.items():
            out.append({"split": name, "measure": f"{kind}edge_r2", "value": float(models.column_r2(here, matrix, offset).mean())})
            for k in ks:
                mean, axes = models.components(s, k)
                out.append({"split": name, "measure": f"{kind}pc_r2_{k}", "value": float(models.component_r2(here, models.Fit(matrix, offset, 0, 0), mean, axes).mean())})
    kinds = (*spd.METRICS, "bures")
    far = known.select(split, *[spd.distance(F.col("m"), F.col("f"), k).alias(k) for k in kinds])
    told = far.groupBy(split).agg(F.count("*").alias("n"), *[f(k).alias(f"{n}_{k}") for k in kinds for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    for r in told.collect():
        out += [{"split": r[split], "measure": c, "value": float(r[c])} for c in told.columns if c != split]
    return out
