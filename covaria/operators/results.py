"""Result tables in tidy form: method, dataset, metric, k, seed, value."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covaria.operators.splits import running_before

# Two-sided 95% points of Student's t by degrees of freedom.
T_POINTS = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
    11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 20: 2.086, 25: 2.060, 30: 2.042,
}


def t_point(df: Column) -> Column:
    """Point of t by degrees of freedom: linear between table entries, 2.000 from 31 and 1.960 from 60 on."""
    out = F.when(df >= 60, F.lit(1.96)).when(df >= 31, F.lit(2.0))
    points = sorted(T_POINTS)
    for lo, hi in zip(points, points[1:], strict=False):
        out = out.when((df >= lo) & (df < hi), T_POINTS[lo] + (df - lo) / float(hi - lo) * (T_POINTS[hi] - T_POINTS[lo]))
    return out.when(df == points[-1], T_POINTS[points[-1]])


def t_point_short(df: Column) -> Column:
    """The coarser rule of per-run summaries: the table to 10, then 2.0, and 1.96 from 30 on."""
    out = F.when(df >= 30, F.lit(1.96)).when(df > 10, F.lit(2.0))
    for k in range(1, 11):
        out = out.when(df == k, T_POINTS[k])
    return out


def seed_summary(rows: DataFrame, value: str, *keys: str, short: bool = True) -> DataFrame:
    """n, mean, sd (ddof 1) and half width of the 95% interval over seeds; both are null for one seed."""
    per = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    rule = t_point_short if short else t_point
    return per.withColumn("ci95", F.when(F.col("n") > 1, rule(F.col("n") - 1) * F.col("sd") / F.sqrt("n")))


def group_mean_sd(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sd (ddof 1) of each value; null keys form groups of their own."""
    return rows.groupBy(*keys).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def ranking(rows: DataFrame, method: str, value: str) -> DataFrame:
    """Methods by value, the greatest first and null last, ties by name."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col(value).desc_nulls_last(), method)))


def paired_t(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """n, mean difference, its sd (ddof 1) and Student's t over pairs."""
    d = F.col(a) - F.col(b)
    per = rows.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    return per.withColumn("t", F.when((F.col("n") > 1) & (F.col("sd_diff") > 0), F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n"))))


def early_stop(tests: DataFrame, keys: Sequence[str], order: Sequence[str], not_significant: str, stop: int = 3) -> DataFrame:
    """(keys, tested): how many tests of each group run, in an order that tells them apart, until `stop` in a row aren't significant.

    Tests are numbered over ranges; one that isn't significant counts for its own place and the next stop - 1, and the first
    place with `stop` of them ends the group. So a group with most of the tests is many tasks. Null results count as significant;
    keys aren't null.
    """
    numbered = running_before(tests.withColumn("_one", F.lit(1)), keys, order, "_one", "_at")
    ends = numbered.where(F.col(not_significant)).select(*keys, F.explode(F.sequence(F.col("_at"), F.col("_at") + (stop - 1))).alias("_p"))
    first = ends.groupBy(*keys, "_p").count().where(F.col("count") == stop).groupBy(*keys).agg(F.min("_p").alias("_end"))
    return numbered.join(first, list(keys), "left").where(F.col("_end").isNull() | (F.col("_at") <= F.col("_end"))).groupBy(*keys).agg(F.count("*").alias("tested"))


def bca_interval(values: Sequence[float], replicates: int = 2000, seed: int = 42, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected, accelerated interval of the mean of a few values (one per seed)."""
    x = np.asarray(values, dtype=float)
    boot = np.sort(np.random.default_rng(seed).choice(x, (replicates, len(x))).mean(axis=1))
    normal = NormalDist()
    z0 = normal.inv_cdf(min(max(float((boot < x.mean()).mean()), 0.5 / replicates), 1 - 0.5 / replicates))
    jack = (x.sum() - x) / (len(x) - 1)
    gap = jack.mean() - jack
    spread = (gap**2).sum() ** 1.5 * 6
    a = (gap**3).sum() / spread if spread > 0 else 0.0
    out = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal.inv_cdf(p)
        out.append(float(np.quantile(boot, min(max(normal.cdf(z0 + z / (1 - a * z)), 0.0), 1.0))))
    return out[0], out[1]
