"""Analyses of a fitted map against refits on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.operators import analyses, geometry, inference, models, moments

N, P, Q = 240, 5, 7


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(31)
    x = rng.standard_normal((N, P))
    y = x[:, :2] @ rng.standard_normal((2, Q)) + np.sin(2 * x[:, 4:5]) * rng.standard_normal((1, Q)) * 1.5 + 0.5 * rng.standard_normal((N, Q))
    return x, y, np.array(["train", "val", "test"])[np.searchsorted([150, 190], np.arange(N), side="right")], np.arange(N) % 3 > 0


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, split, control = data
    return spark.createDataFrame([(i, x[i].tolist(), y[i].tolist(), str(split[i]), bool(control[i])) for i in range(N)], "id int, x array<double>, y array<double>, split string, control boolean").repartition(4)


@pytest.fixture(scope="module")
def by(rows):
    return moments.stats_by(rows, "x", "y", ["split", "control"])


def test_shares_of_features_and_ranks(data, by):
    x, y, _, _ = data
    s = analyses.plus(list(by.values()))
    u = np.linalg.qr(np.random.default_rng(1).standard_normal((P, 3)))[0]
    for r in analyses.rank_sweep(s, u, (1, 3)):
        assert np.isclose(r["coupled"], ((x @ u[:, : r["r"]]) ** 2).sum() / (x**2).sum()) and np.isclose(r["coupled"] + r["uncoupled"], 1)
    share = analyses.feature_shares(s, u)
    assert np.allclose(share, (x @ u @ u.T).var(axis=0) / x.var(axis=0))
    told = analyses.group_shares(share, ["a", "a", "b", "b", "c"])
    assert np.isclose(told[0]["mean"], share[:2].mean()) and np.isclose(told[0]["sd"], share[:2].std(ddof=1)) and told[2]["sd"] is None
    z = moments.Stats(s.n, s.sx * 0, s.sy, s.xx * 0, s.xy, s.yy)
    assert (analyses.feature_shares(z, u) == 0).all()


def test_stability():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((P, Q))
    (same, _, other) = analyses.stability({"a": a, "b": a @ np.diag(np.ones(Q)), "c": rng.standard_normal((P, Q))}, 2)
    assert same["max_angle"] < 1e-5 and same["mean_cos"] > 1 - 1e-9 and other["max_angle"] > 1


def test_kernel_ridge_on_all_rows_is_the_kernels_own(spark, rows, data):
    """With every training row a landmark: exact kernel ridge on the residual block, and a null below it."""
    x, y, split, _ = data
    u = np.linalg.qr(np.eye(P)[:, :2])[0]
    r = analyses.nonlinear_residual(rows.where("split = 'train'"), rows.where("split = 'test'"), "id", "x", "y", u, m=150, replicates=30).first()
    z = x - x @ u @ u.T
    tr, te = split == "train", split == "test"
    d2 = ((z[:, None] - z[tr][None]) ** 2).sum(axis=2)
    d = np.sqrt(d2[tr])
    gamma = 1 / (2 * np.median(d[d > 0]) ** 2)
    k = np.exp(-gamma * d2)
    r2 = lambda t, p: (1 - ((t - p) ** 2).sum(axis=0) / ((t - t.mean(axis=0)) ** 2).sum(axis=0)).mean()
    want = r2(y[te], k[te] @ np.linalg.solve(k[tr] + np.eye(tr.sum()), y[tr]))
    a, m = z[tr] - z[tr].mean(axis=0), y[tr].mean(axis=0)
    linear = r2(y[te], (z[te] - z[tr].mean(axis=0)) @ np.linalg.solve(a.T @ a + np.eye(P), a.T @ (y[tr] - m)) + m)
    assert np.isclose(r["gamma"], gamma) and np.isclose(r["r2_kernel"], want, atol=1e-6) and np.isclose(r["r2_linear"], linear)
    assert r["r2_kernel"] > r["null_p95"] and r["p"] < 0.05 and r["n_null"] == 30
    with pytest.raises(ValueError, match="landmarks"):
        analyses.landmarks(rows, "id", "x", 0)


def test_controls_refit(by, data):
    """Everybody's statistics are sums of the groups'; values are those of maps fitted to rows."""
    x, y, split, control = data
    got = {(r["k"], r["measure"]): r["value"] for r in analyses.controls_refit(by, (2, 3), "ridge", alphas=[1.0])}
    maps = {}
    for name, at in (("controls", control), ("mixed", np.ones(N, dtype=bool))):
        t = at & (split == "train")
        a, m = x[t] - x[t].mean(axis=0), y[t].mean(axis=0)
        b = np.linalg.solve(a.T @ a + np.eye(P), a.T @ (y[t] - m))
        maps[name] = b, m - x[t].mean(axis=0) @ b
    for where, at in (("controls", control & (split == "test")), ("everyone", split == "test")):
        for name, (b, c) in maps.items():
            p, t = x[at] @ b + c, y[at]
            assert np.isclose(got[0, f"r2_{name}_on_{where}"], 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum())
            actual, told = (np.linalg.svd(m, full_matrices=False)[2][:2].T for m in (t, x[at] @ b))
            assert np.isclose(got[2, f"overlap_{name}_on_{where}"], ((actual.T @ told) ** 2).sum() / 2)
    va, vb = (np.linalg.svd(b, full_matrices=False)[2][:3].T for b, _ in maps.values())
    assert np.isclose(got[3, "overlap_of_maps"], ((va.T @ vb) ** 2).sum() / 3) and got[0, "rank_mixed"] == P


def test_dissociation(spark, by, data):
    x, y, split, _ = data
    train, test = (analyses.plus([v for (s, _), v in by.items() if s == name]) for name in ("train", "test"))
    fits = {"full": models.ridge(train, train, [1.0]), "null": models.Fit(np.zeros((P, Q)), np.zeros(Q), 0, 0)}
    got = {(r["method"], r["k"]): r for r in analyses.dissociation(spark, test, fits, (1, 2), 200).collect()}
    assert len(got) == 4 and got["full", 2]["p"] < 0.1 and got["null", 2]["effective_rank"] == 0 and got["full", 2]["effective_rank"] == P
    assert abs(got["full", 2]["null_mean"] - 2 / Q) < 0.05 and np.isclose(got["full", 1]["ratio"], got["full", 1]["overlap"] / got["full", 1]["r2"])


def test_theory_and_positions(spark, rows, by, data):
    x, y, split, _ = data
    train, test = (analyses.plus([v for (s, _), v in by.items() if s == name]) for name in ("train", "test"))
    fit = models.ridge(train, train, [1.0])
    told = analyses.theory(train, test, fit, 3)
    te, tr = split == "test", split == "train"
    noise2 = ((y[te] - x[te] @ fit.b - fit.intercept) ** 2).mean()
    u, d, _ = np.linalg.svd(fit.b, full_matrices=False)
    signal = (d[:3] ** 2 * (x[tr] @ u[:, :3]).var(axis=0)).sum()
    assert np.isclose(told["noise2"], noise2) and np.isclose(told["gamma"], P / tr.sum()) and np.isclose(told["r2_theory"], signal / (signal + Q * noise2))
    assert np.isclose(told["overlap_theory"], geometry.spiked_overlap(d[:3], noise2**0.5, P / tr.sum())) and told["n_recovered"] == (d[:3] / noise2**0.5 > told["edge"]).sum()
    gradient = np.arange(P) * 1.0
    got = {r["mode"]: r for r in analyses.position_intervals(rows, "id", "x", "y", gradient, 2, 40).collect()}
    cov = (x - x.mean(axis=0)).T @ (y - y.mean(axis=0)) / N
    want = [(np.abs(v) * gradient).sum() / np.abs(v).sum() for v in np.linalg.svd(cov)[0].T[:2]]
    assert np.allclose([got[1]["position"], got[2]["position"]], want) and got[1]["lo"] <= got[1]["position"] <= got[1]["hi"]


def test_prediction_suite(data, rows, by):
    """Summaries of ridge maps to groups of targets equal those of predictions on rows."""
    x, y, split, _ = data
    stats = {name: analyses.plus([v for (s, _), v in by.items() if s == name]) for name in ("train", "val", "test")}
    (r,) = [r for r in analyses.prediction_suite(stats, {"some": [0, 3]}, [0.1, 1.0]) if r["dataset"] == "test"]
    t = y[:, [0, 3]]
    tr, va, te = (split == s for s in ("train", "val", "test"))
    a, m = x[tr] - x[tr].mean(axis=0), t[tr].mean(axis=0)
    fits = {al: np.linalg.solve(a.T @ a + al * np.eye(P), a.T @ (t[tr] - m)) for al in (0.1, 1.0)}
    told = lambda al, at: (x[at] - x[tr].mean(axis=0)) @ fits[al] + m
    best = max(fits, key=lambda al: -((t[va] - told(al, va)) ** 2).sum())
    p = told(best, te)
    r2 = 1 - ((t[te] - p) ** 2).sum(axis=0) / ((t[te] - t[te].mean(axis=0)) ** 2).sum(axis=0)
    corr = [np.corrcoef(t[te][:, j], p[:, j])[0, 1] for j in range(2)]
    assert r["alpha"] == best and np.isclose(r["r2_mean"], r2.mean()) and np.isclose(r["corr_mean"], np.mean(corr)) and np.isclose(r["slope"], np.polyfit(p.ravel(), t[te].ravel(), 1)[0]) and r["n_targets"] == 2
    flat = analyses.regression_summary(analyses.columns_of(stats["test"], [1]), np.zeros((P, 1)), np.zeros(1))
    assert flat["corr_mean"] == 0 and flat["slope"] == 0


def test_prediction_targets(spark):
    names = ["occ", "dwell", "energy"]
    row = {f"{n}_{i}": 0.25 + 0.5 * i for n in names for i in range(2)} | {f"tp_{i}_{j}": (0.3, 0.7)[j] for i in range(2) for j in range(2)} | {"switching_rate": 0.5, "transition_entropy": 0.2}
    df = spark.createDataFrame([("u", *row.values())], "user string, " + ", ".join(f"{c} double" for c in row))
    targets, groups = analyses.prediction_targets(df, "user", 2)
    y = np.array(targets.first()["y"])
    logs = np.log(np.array([0.25, 0.75]) + 1e-6)
    assert len(y) == 2 + 2 + 2 + 1 + 1 + 4 and np.allclose(y[groups["occupancy"]], logs - logs.mean(), atol=1e-6)
    assert np.allclose(y[groups["dwell"]], np.log1p([0.25, 0.75])) and np.isclose(y[groups["switching_rate"][0]], np.log1p(0.5))
    assert np.isclose(y[groups["transition_matrix"]].sum(), 0) and sorted(groups["slow_bundle"] + groups["fast_bundle"]) == list(range(12))


def test_kernel_spectral(by):
    """Every point of both grids against plain products; shrinkage is searched with the rest, thresholds at the best ridge."""
    train, val = (analyses.plus([v for (s, _), v in by.items() if s == name]) for name in ("train", "val"))
    got = models.kernel_spectral({1.0: (train, val), 2.0: (val, train)}, (0.1, 10.0), (0.5, 1.0))
    plain, shrunk = {}, {}
    for w, (t, v) in {1.0: (train, val), 2.0: (val, train)}.items():
        cxx, cxy, _ = t.centered()
        for a in (0.1, 10.0):
            b = np.linalg.solve(cxx + a * np.eye(P), cxy)
            plain[w, a] = models.r2(v, b, (t.sy - t.sx @ b) / t.n), b
            for m in (0.5, 1.0):
                c = models.shrunk(b, m)
                shrunk[w, a, m] = models.r2(v, c, (t.sy - t.sx @ c) / t.n)
    w, a = max(plain, key=lambda k: plain[k][0])
    assert (got["plain"].bandwidth, got["plain"].alpha) == (w, a) and np.isclose(got["plain"].fit.score, plain[w, a][0])
    assert np.isclose(got["shrunk"].fit.score, max(shrunk.values())) and np.isclose(shrunk[got["shrunk"].bandwidth, got["shrunk"].alpha, got["shrunk"].shrinkage], max(shrunk.values()))
    assert got["soft"].fit.score >= got["plain"].fit.score - 1e-12 and got["soft"].shrinkage in models.THRESHOLDS


def test_estimator_ranks(by):
    s = analyses.plus([v for (split, _), v in by.items() if split == "train"])
    got = {r["estimator"]: r for r in analyses.estimator_ranks(s, 0.3)}
    assert set(got) == {"nuclear_norm_0.3", "ridge_1", "ridge_10", "ridge_100", "ols"} and got["ols"]["effective_rank"] == P
    cxx, cxy, _ = s.centered()
    d = np.linalg.svd(np.linalg.solve(cxx, cxy), compute_uv=False)
    assert np.isclose(got["ols"]["max_gap"], np.max(-np.diff(np.log10(d)))) and got["nuclear_norm_0.3"]["effective_rank"] < P


def test_mapped_blocks_keep_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [3.0, 4.0])], "id int, x array<double>").coalesce(1)
    got = {r["id"]: r["z"] for r in moments.mapped(df, "x", lambda b: b * 2, "z").collect()}
    assert got == {1: [2.0, 4.0], 2: None, 3: [6.0, 8.0]}
    assert {r["z"] is None for r in moments.mapped(df.where("id = 2"), "x", lambda b: b * 2, "z").collect()} == {True}
    assert inference.drawn_times(np.array([], dtype=np.int64), 0, 1).tolist() == []
