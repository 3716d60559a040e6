"""Transforms that are fitted on training rows and applied everywhere: design matrices, scaling, residuals, calibration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.operators import moments, splits

MISSING = "__MISSING__"


def numeric_like(tables: Sequence[DataFrame], column: str, share: float = 0.9) -> bool:
    """Whether at least `share` of the non-null values parse as numbers in one of the tables."""
    return any((t.agg(F.avg(F.col(column).try_cast("double").isNotNull().cast("double")).alias("s")).first()["s"] or 0) >= share for t in (t.where(F.col(column).isNotNull()) for t in tables))


@dataclass
class Design:
    """Columns of a design matrix, learnt from training rows: medians of numeric ones and levels of the others."""

    medians: dict[str, float]
    levels: dict[str, list[str]]

    def names(self) -> list[str]:
        return ["intercept", *self.medians, *(f"{c}={v}" for c, levels in self.levels.items() for v in levels[1:])]

    def columns(self) -> list[Column]:
        """Values in the order of names(): numbers with nulls as the median, 0/1 of each level but the first."""
        value = lambda c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(None)), F.lit(m)) if (m := self.medians[c]) is not None else F.lit(0.0)
        dummy = lambda c, v: (F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == v).cast("double")
        return [F.lit(1.0), *[value(c) for c in self.medians], *[dummy(c, v) for c, levels in self.levels.items() for v in levels[1:]]]

    def apply(self, rows: DataFrame, name: str = "design") -> DataFrame:
        """Add the design row as an array; a level that training rows don't have gets zeros."""
        return rows.withColumn(name, F.array(*self.columns()))

    def unseen(self, rows: DataFrame, column: str) -> DataFrame:
        """Levels of rows that training rows don't have, with their counts."""
        level = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
        return rows.select(level.alias("level")).where(~F.col("level").isin(*self.levels[column])).groupBy("level").agg(F.count("*").alias("n"))


def fit_design(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], most_levels: int = 10_000) -> Design:
    """Medians (0 where all are null) and sorted levels, null as a level of its own, of training rows only.

    All medians are found by ranges in one pass, levels by one aggregation a column; raises beyond `most_levels`, which bounds
    the design.
    """
    found = {c: q[0] for c, q in splits.quantiles_of(train, {c: F.col(c).try_cast("double") for c in numeric}, [0.5]).items()}
    levels = {}
    for c in categorical:
        got = train.select(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("v")).distinct().limit(most_levels + 1).collect()
        if len(got) > most_levels:
            raise ValueError(f"{c} has more than {most_levels} levels")
        levels[c] = sorted(r["v"] for r in got)
    return Design({c: 0.0 if found[c] is None else float(found[c]) for c in numeric}, levels)


def scaler(rows: DataFrame, vector: str, train: str) -> DataFrame:
    """(j, n, mean, sd) over training rows."""
    return moments.column_stats(rows, vector, train)


def scale(rows: DataFrame, vector: str, fitted: DataFrame, eps: float = 0.0) -> DataFrame:
    """Standardize a vector column by (j, mean, sd), which is one row per feature and goes into the plan as literals."""
    per = sorted(fitted.select("j", "mean", "sd").collect(), key=lambda r: r["j"])
    mean, sd = F.lit([r["mean"] for r in per]), F.lit([r["sd"] + eps for r in per])
    return rows.withColumn(vector, F.zip_with(F.zip_with(F.col(vector).cast("array<double>"), mean, lambda v, m: v - m), sd, lambda v, s: v / s))


def fit_ols(rows: DataFrame, design: str, vector: str) -> np.ndarray:
    """Least squares of each feature on the design columns, of least norm where these are dependent."""
    s = moments.stats(rows, design, vector)
    return np.linalg.pinv(s.xx) @ s.xy


def residualize(rows: DataFrame, design: str, vector: str, beta: np.ndarray) -> DataFrame:
    """Subtract what the design explains; beta (design columns x features) is broadcast as a matrix."""
    fitted = moments.linear_map(rows, design, beta, name="_fitted")
    return fitted.withColumn(vector, F.zip_with(F.col(vector).cast("array<double>"), F.col("_fitted"), lambda v, f: v - f)).drop("_fitted")


def regress_out(long_rows: DataFrame, key: str, covariate: str) -> DataFrame:
    """(key, j, v): residuals of long rows (key, j, v, covariate) on one covariate, feature by feature."""
    fit = long_rows.groupBy("j").agg(F.regr_slope("v", covariate).alias("_b"), F.regr_intercept("v", covariate).alias("_a"))
    return long_rows.join(fit, "j").select(key, "j", (F.col("v") - F.col("_a") - F.col("_b") * F.col(covariate)).alias("v"))


def center_by(long_rows: DataFrame, group: str, key: str) -> DataFrame:
    """(key, group, j, v) with the group's mean of each feature taken off; groups of one row stay as they are.

    Means are aggregated and joined back: a group with a third of all rows is only ever summed in parts.
    """
    means = long_rows.groupBy(group, "j").agg(F.avg("v").alias("_m"), F.count("*").alias("_n"))
    return long_rows.join(means, [group, "j"]).select(key, group, "j", F.when(F.col("_n") > 1, F.col("v") - F.col("_m")).otherwise(F.col("v")).alias("v"))


def calibration(pairs: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(j, scale, offset) that maps predictions onto truth, from rows (j, y, p): scale is their covariance by the prediction's variance."""
    per = pairs.groupBy("j").agg(F.covar_pop("y", "p").alias("c"), F.var_pop("p").alias("v"), F.avg("y").alias("my"), F.avg("p").alias("mp"))
    slope = F.col("c") / (F.col("v") + eps)
    return per.select("j", slope.alias("scale"), (F.col("my") - slope * F.col("mp")).alias("offset"))
