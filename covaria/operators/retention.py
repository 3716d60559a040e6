"""Retention of state centroids in a map's subspace, by tier, rank and state, and of accuracy across cohorts, with intervals.

Bootstraps draw subjects; what meets a replicate is one row of sums per state, or of errors per method and component, and
the subspaces are applied in the replicate's own task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.operators import geometry, models, moments
from covaria.operators.inference import Products, by_products, resampled_products


def orthonormal(v: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    """An orthonormal basis of a matrix' columns."""
    u, d, _ = np.linalg.svd(v, full_matrices=False)
    return u[:, d > eps * d.max(initial=0)]


def shares(v: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Share of each row's energy inside the span of v's columns, 0 for a zero row."""
    energy = (vectors**2).sum(axis=1)
    return np.where(energy > 0, ((vectors @ orthonormal(v)) ** 2).sum(axis=1) / np.where(energy > 0, energy, 1), 0.0)


def table(centroids: np.ndarray, v: np.ndarray, ranks: Sequence[int], masks: dict[str, Sequence[int]] | None = None) -> list[dict]:
    """(tier, r, state, rho, chance, lift, n_edges) of centroids (a row each) in the leading r columns of v (q x k).

    Tier "all" has all features; a tier's basis is v cut to its features and made orthonormal again. State -1 has the mean of rho.
    Chance is the basis' dimensions by features. Tiers without features give no rows.
    """
    out = []
    for tier, at in {"all": list(range(len(v))), **(masks or {})}.items():
        if not len(at):
            continue
        for r in ranks:
            basis = v[np.ix_(list(at), range(min(r, v.shape[1])))]
            rho, chance = shares(basis, centroids[:, list(at)]), orthonormal(basis).shape[1] / len(at)
            for state, value in [*enumerate(rho), (-1, rho.mean())]:
                out.append({"tier": tier, "r": int(r), "state": int(state), "rho": float(value), "chance": float(chance), "lift": float(value / max(chance, 1e-30)), "n_edges": len(at)})
    return out


def differences(centroids: np.ndarray, v: np.ndarray) -> list[dict]:
    """(state_a, state_b, rho): retention of what leads from one state's centroid to another's."""
    pairs = list(combinations(range(len(centroids)), 2))
    rho = shares(v, np.array([centroids[b] - centroids[a] for a, b in pairs]).reshape(len(pairs), -1)) if pairs else []
    return [{"state_a": a, "state_b": b, "rho": float(x)} for (a, b), x in zip(pairs, rho, strict=True)]


def _centroids(p: Products) -> np.ndarray:
    """States' means from products of their one-hot block with [count, sums]; a state without rows has zeros."""
    n = p.xy[:, :1]
    return np.where(n > 0, p.xy[:, 1:] / np.where(n > 0, n, 1), 0.0)


def by_state(windows: DataFrame, subject: str, state: str, w: str, states: int) -> DataFrame:
    """(subject, onehot, sums): per subject and state its windows' number and sums. States are 0 to states - 1; others don't count.

    Sums are taken in tasks first, so a subject or state with most of the windows is no single task.
    """
    known = windows.where(F.col(w).isNotNull() & F.col(state).between(0, states - 1)).select(F.col(subject).cast("string").alias("subject"), F.col(state).cast("int").alias("state"), F.array(F.lit(1.0)).alias("one"), F.concat(F.array(F.lit(1.0)), F.col(w).cast("array<double>")).alias("w"))
    sums = moments.product_rows(known, "one", "w", "subject", "state")
    return sums.select("subject", F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda k: (k == F.col("state")).cast("double")).alias("onehot"), F.col("row").alias("sums"))


def state_retention(
    windows: DataFrame, subject: str, state: str, w: str, states: int, v: np.ndarray, ranks: Sequence[int], masks: dict[str, Sequence[int]] | None = None, replicates: int = 500, seed: int = 42, level: float = 0.95,
) -> DataFrame:
    """(tier, r, state, rho, chance, lift, n_edges, boot_mean, lo, hi): retention of state centroids with intervals.

    Intervals are percentiles over a cluster bootstrap: subjects are drawn and bring all their windows, so centroids are
    weighted sums, taken for all replicates in one pass over rows of (subject, state). State -1 is the mean over states. Rows
    with a null vector or a state out of range don't count; a null subject is a subject; without rows there is no result.
    """
    products = resampled_products(by_state(windows, subject, state, w, states), "subject", "onehot", "sums", replicates, seed, "bootstrap", cluster=True, observed=True)
    kinds = "tier string, r long, state long, rho double, chance double, lift double, n_edges long"
    told = by_products(products, lambda by: table(_centroids(by[()]), v, ranks, masks), kinds)
    a = (1 - level) / 2
    boot = told.where("rep >= 0").groupBy("tier", "r", "state").agg(F.avg("rho").alias("boot_mean"), F.percentile("rho", a).alias("lo"), F.percentile("rho", 1 - a).alias("hi"))
    return told.where("rep < 0").drop("rep").join(boot, ["tier", "r", "state"])


def local_overlaps(windows: DataFrame, state: str, w: str, v: np.ndarray, most: int) -> DataFrame:
    """(state, n_windows, k_local, overlap, chance): leading directions of a state's own windows against v's.

    k_local is the least of most, n_windows - 1, q and v's columns; a state of fewer than three windows has k_local 0 and nulls.
    Each state's products are summed in tasks and solved in one of its own.
    """
    q = len(v)

    def solve(by: dict[tuple, moments.Stats]) -> list[dict]:
        (s,) = by.values()
        n = int(s.n)
        k = min(most, n - 1, q, v.shape[1]) if n >= 3 else 0
        if not k:
            return [{"n_windows": n, "k_local": 0, "overlap": None, "chance": None}]
        axes = np.linalg.eigh(s.centered()[0])[1][:, ::-1][:, :k]
        return [{"n_windows": n, "k_local": k, "overlap": geometry.overlap(axes, v[:, :k]), "chance": k / q}]

    known = windows.where(F.col(w).isNotNull() & F.col(state).isNotNull()).withColumn("_none", F.array().cast("array<double>"))
    return moments.solve_by(known, w, "_none", [state], solve, "n_windows long, k_local long, overlap double, chance double")


def component_errors(rows: DataFrame, key: str, x: str, y: str, dataset: str, fits: dict[str, models.Fit], mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(key, dataset, errors): squared truth scores, then squared errors of each method's scores, on axes (q x k), in one array."""
    p, q = next(iter(fits.values())).b.shape
    k = axes.shape[1]
    truth = np.vstack([np.zeros((p, k)), axes])
    parts = [truth, *(np.vstack([-f.b @ axes, axes]) for f in fits.values())]
    offsets = [-mean @ axes, *(-f.intercept @ axes for f in fits.values())]
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, dataset, F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).alias("_xy"))
    mapped = moments.linear_map(both, "_xy", np.hstack(parts), np.concatenate(offsets), "errors")
    return mapped.select(key, dataset, F.transform("errors", lambda e: e * e).alias("errors"))


def accuracy_retention(
    errors: DataFrame, key: str, dataset: str, methods: Sequence[str], pairs: Sequence[tuple[str, str]] = (), replicates: int = 2000, seed: int = 42, level: float = 0.95, keys: Sequence[str] = (),
) -> DataFrame:
    """(name, measure, value, boot_mean, lo, hi, p): component R2 on the test rows and an external cohort, and its retention.

    errors: key, dataset ("test" or "external") and the array of component_errors; rows of one key and dataset (such as seeds of
    the evaluation) are averaged. Each replicate draws subjects once for all methods, so differences of a pair of methods
    (name "a - b") are paired; p is the share of replicates at or below 0. Retention is external by test, null where test
    isn't positive; such replicates don't count.
    """
    means = errors.where(F.col(dataset).isin("test", "external")).select(F.col(key).cast("string").alias("k"), F.col(dataset).alias("d"), F.array(F.lit(1.0)).alias("one"), F.concat(F.array(F.lit(1.0)), "errors").alias("e"))
    sums = moments.product_rows(means, "one", "e", "k", "d")
    averaged = sums.select("k", F.array((F.col("d") == "test").cast("double"), (F.col("d") == "external").cast("double")).alias("onehot"), F.transform(F.slice("row", 2, F.size("row") - 1), lambda v: v / F.col("row")[0]).alias("e"))
    products = resampled_products(averaged, "k", "onehot", "e", replicates, seed, "bootstrap", cluster=True, observed=True)

    def told(by: dict[tuple, Products]) -> list[dict]:
        cells = by[()].xy.reshape(2, 1 + len(methods), -1)
        r2 = (1 - cells[:, 1:] / (cells[:, :1] + 1e-12)).mean(axis=2)  # dataset x method
        out = []
        for i, m in enumerate(methods):
            test, ext = (float(v) for v in r2[:, i])
            out += [{"name": m, "measure": "test", "value": test}, {"name": m, "measure": "external", "value": ext}, {"name": m, "measure": "retention", "value": ext / test if test > 0 else None}]
        at = {m: i for i, m in enumerate(methods)}
        return out + [{"name": f"{a} - {b}", "measure": w, "value": float(r2[d, at[a]] - r2[d, at[b]])} for a, b in pairs for d, w in enumerate(("test", "external"))]

    found = by_products(products, told, "name string, measure string, value double")
    a = (1 - level) / 2
    v = F.col("value")
    boot = found.where("rep >= 0").groupBy("name", "measure").agg(F.avg(v).alias("boot_mean"), F.percentile(v, a).alias("lo"), F.percentile(v, 1 - a).alias("hi"), (F.count_if(v <= 0) / F.count(v)).alias("p"))
    return found.where("rep < 0").drop("rep").join(boot, ["name", "measure"])
