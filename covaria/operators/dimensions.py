"""How many dimensions a coupling has, and whether that is more than chance gives: ladders, participation ratios, floors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.operators import geometry, moments
from covaria.operators.inference import Products, by_products, resampled_products
from covaria.operators.splits import draw, ranked

# Sizes of subspaces whose overlap is told.
KS = (3, 6, 10)


def participation(c: np.ndarray) -> float:
    """Participation ratio of a matrix' squared singular values, from its products alone."""
    k = c @ c.T if len(c) <= c.shape[1] else c.T @ c
    return float(np.trace(k) ** 2 / (k**2).sum()) if (k != 0).any() else 0.0


def measures(c: np.ndarray, top: int = 10) -> dict:
    """Participation ratio, entropy rank, hard-threshold rank and leading singular values of a cross-covariance."""
    d = np.linalg.svd(c, compute_uv=False)
    some = d[d > 0]
    beta = min(c.shape) / max(c.shape)
    return {
        "participation_ratio": geometry.participation_ratio(d), "entropy_rank": geometry.entropy_rank(d) if len(some) else 0.0, "threshold_rank": geometry.threshold_rank(some, beta) if len(some) else 0,
        "sigma": [float(v) for v in d[:top]],
    }


def _residual(s: moments.Stats, covariates: int) -> np.ndarray:
    """Cross-covariance of x and y less what their leading covariates (the first columns of x) explain: a Schur complement."""
    cxx, cxy, _ = s.centered()
    d = slice(0, covariates)
    rest = cxy[covariates:] - cxx[covariates:, d] @ np.linalg.pinv(cxx[d, d], hermitian=True) @ cxy[d]
    return rest / s.n


def ladder(rows: DataFrame, key: str, x: str, y: str, start: int = 1000, stratum: str | None = None, covariates: str | None = None, seed: int = 42) -> list[dict]:
    """(n, and the measures) on nested draws of about start, 2 start, 4 start, ... rows, up to all of them.

    A draw takes each stratum by its share: rows are ranked within strata by a hash of key and seed, and a row's rank by its
    stratum's size says at which rung it joins. Every row is summed once, for that rung; sums of rungs are added up.
    covariates (an array column): both blocks are residualized on them within each draw. Rows with a null block don't count, and
    keys are unique; an empty table has no rungs. Rungs are as many as doublings, so few.
    """
    known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (x, y, *([covariates] if covariates else []))))
    placed = ranked(known, key, draw(F.col(key), seed), *([stratum] if stratum else []))
    total = known.count()
    if not total:
        return []
    rungs = max(0, int(np.ceil(np.log2(total / start))))
    share = (F.col("_rank") - 0.5) / F.col("_size") * total / start
    rung = F.greatest(F.lit(0), F.least(F.lit(rungs), F.ceil(F.log2(share)).cast("int")))
    left = F.concat(F.col(covariates).cast("array<double>"), F.col(x).cast("array<double>")) if covariates else F.col(x)
    by = moments.stats_by(placed.select(rung.alias("rung"), left.alias("_l"), F.col(y).alias("_r"), (F.size(covariates) if covariates else F.lit(0)).alias("k")), "_l", "_r", ["rung", "k"])
    out, so_far = [], None
    for (_, k), s in sorted(by.items()):
        so_far = s if so_far is None else moments.Stats(*(getattr(so_far, f) + getattr(s, f) for f in ("n", "sx", "sy", "xx", "xy", "yy")))
        c = _residual(so_far, k) if k else so_far.centered()[1] / so_far.n
        out.append({"n": int(so_far.n), **measures(c)})
    return out


def participation_test(rows: DataFrame, key: str, x: str, y: str, replicates: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: the coupling's participation ratio, its bootstrap interval, that of broken pairs, p and whether they are apart.

    p is the share of broken pairs whose ratio is as low as the observed one, with one added to both counts. Bootstraps keep
    the rows' means; breaking pairs changes none. disjoint: the bootstrap interval ends below where that of broken pairs begins.
    Noise raises the ratio, and a bootstrap adds to the noise, so the basic interval (observed twice, less the percentiles) is
    told too. Columns: n, replicates, observed, boot_mean, boot_lo, boot_hi, basic_lo, basic_hi, null_mean, null_lo, null_hi, p, disjoint.
    """
    s = moments.stats(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y)
    if not s.n:
        raise ValueError("there are no rows to test")
    mx, my = s.sx / s.n, s.sy / s.n
    observed = participation(s.centered()[1])
    ratio = lambda by: [{"ratio": participation(by[()].covariance(mx, my))}]
    a = (1 - level) / 2
    ends = lambda n: [F.avg("ratio").alias(f"{n}_mean"), F.percentile("ratio", a).alias(f"{n}_lo"), F.percentile("ratio", 1 - a).alias(f"{n}_hi")]
    boot = by_products(resampled_products(rows, key, x, y, replicates, seed, "bootstrap"), ratio, "ratio double").agg(*ends("boot")).first()
    p = (F.count_if(F.col("ratio") <= observed) + 1) / (F.count("*") + 1)
    null = by_products(resampled_products(rows, key, x, y, replicates, seed + 1, "break"), ratio, "ratio double").agg(*ends("null"), p.alias("p")).first()
    basic = {"basic_lo": 2 * observed - boot["boot_hi"], "basic_hi": 2 * observed - boot["boot_lo"]}
    told = {"n": int(s.n), "replicates": replicates, "observed": observed, **boot.asDict(), **basic, **null.asDict(), "disjoint": bool(boot["boot_hi"] < null["null_lo"])}
    kinds = ", ".join(f"{k} {'long' if k in ('n', 'replicates') else 'boolean' if k == 'disjoint' else 'double'}" for k in told)
    return rows.sparkSession.createDataFrame([tuple(told.values())], kinds)


def _overlaps(by: dict[tuple, Products], ks: Sequence[int]) -> list[dict]:
    """Overlap of the two leading left subspaces of correlations at each k."""
    if len(by) != 2:
        return []
    a, b = (np.linalg.svd(p.correlation(), full_matrices=False)[0] for _, p in sorted(by.items()))
    return [{"k": int(k), "overlap": geometry.overlap(a[:, :k], b[:, :k])} for k in ks if k <= a.shape[1]]


def _floor(found: DataFrame, *by: str) -> list:
    v = F.col("overlap")
    return [F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.percentile(v, 0.05).alias("p05"), F.percentile(v, 0.95).alias("p95")]


def cohort_floor(rows: DataFrame, key: str, x: str, y: str, cohort: str, ks: Sequence[int] = KS, replicates: int = 100, seed: int = 42) -> DataFrame:
    """(k, observed, mean, sd, p05, p95, above): overlap of two cohorts' leading left subspaces against that of broken pairs.

    Pairs are broken in each cohort on its own; above: the observed overlap exceeds the null's 95th percentile. `cohort` has two
    values; with another number of them there are no rows.
    """
    products = resampled_products(rows.where(F.col(cohort).isNotNull()), key, x, y, replicates, seed, "break", keys=[cohort], observed=True)
    found = by_products(products, lambda by: _overlaps(by, ks), "k long, overlap double", cohort)
    null = found.where("rep >= 0").groupBy("k").agg(*_floor(found))
    seen = found.where("rep < 0").select("k", F.col("overlap").alias("observed"))
    return seen.join(null, "k").select("k", "observed", "mean", "sd", "p05", "p95", (F.col("observed") > F.col("p95")).alias("above"))


def halves_floor(rows: DataFrame, key: str, x: str, y: str, n: int, ks: Sequence[int] = KS, replicates: int = 80, seed: int = 42) -> DataFrame:
    """(pairs, n, k, mean, sd, p05, p95): overlap between two disjoint draws of n rows, with pairs kept and with pairs broken.

    Kept pairs tell what two cohorts of that size show that share their subspace; broken ones tell the floor. n is at most
    half of the rows; draws take their share of each cell of rows, so they have n rows but for rounding.
    """
    total = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).count()
    if not 0 < 2 * n <= total:
        raise ValueError(f"two disjoint draws of {n} rows need as many twice, and there are {total}")
    out = None
    for name, how in (("kept", "halves"), ("broken", "broken_halves")):
        products = resampled_products(rows, key, x, y, replicates, seed, how, share=n / total)
        found = by_products(products, lambda by: _overlaps(by, ks), "k long, overlap double", "half")
        told = found.groupBy("k").agg(*_floor(found)).select(F.lit(name).alias("pairs"), F.lit(n).cast("long").alias("n"), "k", "mean", "sd", "p05", "p95")
        out = told if out is None else out.unionAll(told)
    return out


def detectability(rows: DataFrame, key: str, x: str, y: str, group: str, top: int = 6, replicates: int = 60, seed: int = 42) -> DataFrame:
    """(group, idx, sigma, null_p95, detected): a group's leading singular values of correlations against broken pairs'.

    Groups and their replicates go through one pass; a group's null permutes its own rows.
    """
    products = resampled_products(rows, key, x, y, replicates, seed, "break", keys=[group], observed=True)
    one = lambda by: [{"idx": i, "sigma": float(d)} for i, d in enumerate(np.linalg.svd(by[()].correlation(), compute_uv=False)[:top])]
    found = by_products(products, one, "idx long, sigma double", keys=[group])
    null = found.where("rep >= 0").groupBy(F.col(group).alias("_g"), F.col("idx").alias("_i")).agg(F.percentile("sigma", 0.95).alias("null_p95"))
    seen = found.where("rep < 0")
    return seen.join(null, F.col(group).eqNullSafe(F.col("_g")) & (F.col("idx") == F.col("_i"))).select(group, "idx", "sigma", "null_p95", (F.col("sigma") > F.col("null_p95")).alias("detected"))
