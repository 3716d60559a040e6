"""Sums of blocks against refits on rows; regression of matrices against plain versions and planted maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.operators import blocks, models, spd, tangent


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n, p, q = 300, 5, 7
    c = np.column_stack([rng.uniform(20, 80, n), rng.integers(0, 2, n)])
    x = rng.standard_normal((n, p)) + c @ rng.standard_normal((2, p)) / 40
    y = x @ rng.standard_normal((p, q)) + c @ rng.standard_normal((2, q)) / 30 + rng.standard_normal((n, q))
    c = np.column_stack([c, x.sum(axis=1)])
    split = np.array(["train", "val", "test", "external"])[np.searchsorted([180, 230, 270], np.arange(n), side="right")]
    return c, x, y, split


@pytest.fixture(scope="module")
def rows(spark, data):
    c, x, y, split = data
    return spark.createDataFrame([(c[i].tolist(), x[i].tolist(), y[i].tolist(), str(split[i])) for i in range(len(c))], "c array<double>, x array<double>, y array<double>, split string").repartition(6)


def test_sums_of_blocks(rows, data, spark):
    c, x, y, split = data
    more = rows.union(spark.createDataFrame([(None, [1.0] * 5, [1.0] * 7, "train")], rows.schema))
    by = blocks.sums_by(more, ["c", "x", "y"], ["split"])
    assert set(by) == {("train",), ("val",), ("test",), ("external",)}
    at = split == "test"
    u = np.hstack([np.ones((at.sum(), 1)), c[at], x[at], y[at]])
    assert np.allclose(by["test",].m, u.T @ u)
    assert blocks.sums_by(rows.limit(0), ["x", "y"], ["split"]) == {}
    b = by["train",]
    at = split == "train"
    z = (x[at] - x[at].mean(axis=0)) / x[at].std(axis=0)
    assert np.allclose(b.products(b.scaled(b.weights("x")), b.scaled(b.weights("x"))), z.T @ z)
    assert np.allclose(sum((v for v in by.values()), start=blocks.Blocks(0 * b.m, b.at)).m[0, 0], len(x))


def test_sweep_equals_refits(rows, data):
    """Residuals, moments, components and penalties refitted on rows for each subset."""
    c, x, y, split = data
    subsets = {"none": None, "first": [0], "two": [0, 1], "all": [0, 1, 2]}
    got = blocks.sweep({k: b for (k,), b in blocks.sums_by(rows, ["c", "x", "y"], ["split"]).items()}, subsets, (2, 3), 4)
    assert len(got) == 4 * 2 * 2
    tr, va = split == "train", split == "val"
    for mode, subset in subsets.items():
        d = None if subset is None else np.column_stack([np.ones(len(c)), c[:, subset]])
        left = lambda z: z if d is None else z - d @ np.linalg.lstsq(d[tr], z[tr], rcond=None)[0]  # noqa: B023, E731
        a, b = (lambda z: (z - z[tr].mean(axis=0)) / (z[tr].std(axis=0) + 1e-8))(left(x)), (lambda z: (z - z[tr].mean(axis=0)) / (z[tr].std(axis=0) + 1e-8))(left(y))
        axes = np.linalg.svd(b[tr] - b[tr].mean(axis=0), full_matrices=False)[2]
        r2 = lambda t, p: 1 - ((t - p) ** 2).sum(axis=0) / ((t - t.mean(axis=0)) ** 2).sum(axis=0)
        for k in (2, 3):
            v, m = axes[:k].T, b[tr].mean(axis=0)
            ma, mt = a[tr].mean(axis=0), ((b[tr] - m) @ v).mean(axis=0)
            solved = {al: np.linalg.solve((a[tr] - ma).T @ (a[tr] - ma) + al * np.eye(5), (a[tr] - ma).T @ ((b[tr] - m) @ v - mt)) for al in blocks.SWEEP_ALPHAS}
            best = max(blocks.SWEEP_ALPHAS, key=lambda al: r2((b[va] - m) @ v, (a[va] - ma) @ solved[al] + mt).mean())
            for name in ("test", "external"):
                at = split == name
                told = ((a[at] - ma) @ solved[best] + mt) @ v.T + m
                e = axes[:4].T
                r = next(r for r in got if (r["mode"], r["model_k"], r["dataset"]) == (mode, k, name))
                assert r["alpha"] == best
                assert abs(r["pc_r2"] - r2((b[at] - m) @ e, (told - m) @ e).mean()) < 1e-6 and abs(r["edge_r2"] - r2(b[at], told).mean()) < 1e-6


D, N = 4, 240


@pytest.fixture(scope="module")
def planted():
    """Matrices on a curve: tangent vectors at a base point are a map of x plus a covariate's part and noise."""
    rng = np.random.default_rng(3)
    x, c = rng.standard_normal((N, 6)), rng.uniform(-1, 1, (N, 1))
    q = D * (D + 1) // 2
    b, beta = rng.standard_normal((6, q)) / 6, rng.standard_normal((1, q)) / 3
    root = rng.standard_normal((D, D))
    base = root @ root.T + np.eye(D)
    t = x @ b + c @ beta + 0.03 * rng.standard_normal((N, q))
    half, inverse = spd.spectral(base, np.sqrt), spd.spectral(base, lambda w: 1 / np.sqrt(w))
    m = half @ spd.spectral(inverse @ spd.unvectorize(t) @ inverse, np.exp, None) @ half
    return x, c, m


@pytest.fixture(scope="module")
def matrices(spark, planted):
    x, c, m = planted
    split = np.array(["train", "val", "test"])[np.searchsorted([168, 204], np.arange(N), side="right")]
    return spark.createDataFrame([(i, x[i].tolist(), c[i].tolist(), m[i].ravel().tolist(), str(split[i])) for i in range(N)], "id int, x array<double>, c array<double>, m array<double>, split string").repartition(4)


@pytest.mark.parametrize("metric", ["airm", "log_euclidean"])
@pytest.mark.parametrize("covariates", [None, "c"])
def test_planted_map_is_found(matrices, metric, covariates):
    fitted = tangent.fit(matrices, "m", "x", "split", covariates, metric, steps=400)
    done = tangent.predict(matrices.where("split = 'test'"), fitted, "x", covariates)
    each = done.select(spd.tangent(F.col("m"), fitted.base, metric).alias("t"), spd.tangent(F.col("predicted"), fitted.base, metric).alias("p")).collect()
    t, p = (np.array([r[k] for r in each]) for k in ("t", "p"))
    kept = 1 - ((t - p) ** 2).mean() / (t**2).mean()
    assert kept > (0.95 if covariates else 0.5) and 1 <= fitted.effective_rank() <= 6 and fitted.val_mse > 0
    assert len(fitted.modes()[1]) == 6


def test_fit_equals_a_plain_one(matrices, planted):
    """Base, residualizer, means, map and validation error against NumPy on whole arrays."""
    x, c, m = planted
    fitted = tangent.fit(matrices, "m", "x", "split", "c", "log_euclidean", (0.1, 0.01), steps=4000, tol=1e-9)
    logs = spd.spectral(m, np.log)
    base = spd.spectral(logs[:168].mean(axis=0), np.exp, None)
    assert np.allclose(fitted.base, base)
    t = spd.vectorize(logs - spd.spectral(base, np.log))
    d = np.hstack([np.ones((N, 1)), c])
    beta = np.linalg.lstsq(d[:168], t[:168], rcond=None)[0]
    r = t - d @ beta
    xc, rc = x - x[:168].mean(axis=0), r - r[:168].mean(axis=0)
    xx, xr = xc[:168].T @ xc[:168] / 168, xc[:168].T @ rc[:168] / 168
    best = None
    for ratio in (0.1, 0.01):
        b, step = np.zeros_like(xr), 1 / np.linalg.eigvalsh(xx)[-1]
        for _ in range(6000):
            b = models.soft_threshold(b - step * (xx @ b - xr), step * ratio * np.linalg.norm(xr, 2))
        mse = ((xc[168:204] @ b - rc[168:204]) ** 2).mean()
        if best is None or mse < best[0]:
            best = mse, b, ratio
    assert fitted.chosen == best[2] and np.allclose(fitted.b, best[1], atol=1e-5) and np.isclose(fitted.val_mse, best[0], rtol=1e-4)
    got = tangent.predict(matrices.where("id = 220"), fitted, "x", "c").first()["predicted"]
    vector = xc[220] @ best[1] + r[:168].mean(axis=0) + d[220] @ beta
    assert np.allclose(got, spd.spectral(spd.unvectorize(vector) + spd.spectral(base, np.log), np.exp, None).ravel(), atol=1e-4)
    alone = tangent.predict(matrices.where("id = 220"), fitted, "x", strict=True).first()["predicted"]
    assert np.allclose(alone, spd.spectral(spd.unvectorize(vector - c[220] @ beta[1:]) + spd.spectral(base, np.log), np.exp, None).ravel(), atol=1e-4)
    with pytest.raises(ValueError, match="covariates"):
        tangent.predict(matrices, fitted, "x")


def test_fit_without_validation_or_with_nulls(matrices, spark):
    only = matrices.where("split = 'train'")
    fitted = tangent.fit(only, "m", "x", "split", None, "log_euclidean", (1.0, 0.1, 0.001))
    assert fitted.chosen == 0.1 and fitted.val_mse is None
    gap = only.union(spark.createDataFrame([(900, None, [0.0], [1.0] * 16, "train"), (901, [0.0] * 6, [0.0], None, "train")], only.schema))
    assert np.allclose(tangent.fit(gap, "m", "x", "split", None, "log_euclidean", (1.0, 0.1, 0.001)).b, fitted.b)
    with pytest.raises(ValueError, match="no matrix"):
        tangent.fit(only.limit(0), "m", "x", "split")


def test_evaluation(matrices, planted):
    """Edges, calibration, components and distances against whole arrays."""
    x, c, m = planted
    d = np.sqrt(np.diagonal(m, axis1=1, axis2=2))
    corr = m / d[:, :, None] / d[:, None]
    at = np.triu_indices(D, 1)
    y = np.arctanh(corr[:, at[0], at[1]].clip(-1 + 1e-6, 1 - 1e-6))
    off = np.tanh(y * 0.5)
    f = np.tile(np.eye(D), (N, 1, 1))
    f[:, at[0], at[1]] = f[:, at[1], at[0]] = off
    spark = matrices.sparkSession
    split = np.array(["train", "test"])[(np.arange(N) >= 168).astype(int)]
    df = spark.createDataFrame([(str(split[i]), y[i].tolist(), corr[i].ravel().tolist(), f[i].ravel().tolist()) for i in range(N)], "split string, y array<double>, m array<double>, f array<double>")
    got = {(r["split"], r["measure"]): r["value"] for r in tangent.evaluate(df, "y", "m", "f", "split", D, (2,))}
    te = split == "test"
    p = np.arctanh(off.clip(-1 + 1e-6, 1 - 1e-6))
    r2 = lambda t, p: 1 - ((t - p) ** 2).sum(axis=0) / ((t - t.mean(axis=0)) ** 2).sum(axis=0)
    assert abs(got["test", "edge_r2"] - r2(y[te], p[te]).mean()) < 1e-9 and got["test", "calibrated_edge_r2"] > 0.999 and got["test", "n"] == te.sum()
    axes = np.linalg.svd(y[~te] - y[~te].mean(axis=0), full_matrices=False)[2][:2].T
    assert abs(got["test", "pc_r2_2"] - r2((y[te] - y[~te].mean(axis=0)) @ axes, (p[te] - y[~te].mean(axis=0)) @ axes).mean()) < 1e-9
    logs = spd.spectral(corr, np.log) - spd.spectral(f, np.log)
    assert abs(got["test", "mean_log_euclidean"] - np.sqrt((logs[te] ** 2).sum(axis=(1, 2))).mean()) < 1e-9
