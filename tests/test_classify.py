"""Models fitted together against a plain Newton, areas against pairs counted one by one, nested folds against their definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.operators import classify

P = 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, P))
    y = (x @ np.array([1.0, -1, 0.5, 0, 0, 0]) + rng.logistic(size=400) > 0.3).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i]), int(i % 3)) for i in range(len(x))], "id long, x array<double>, y int, g int").repartition(5)


def newton(x, y, c, steps=60):
    """Sum of log losses plus |w|^2 / 2c, the intercept free."""
    d = np.hstack([np.ones((len(x), 1)), x])
    w, pen = np.zeros(d.shape[1]), np.r_[0, np.full(x.shape[1], 1 / c)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-d @ w))
        w = w - np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(pen), d.T @ (p - y) + pen * w)
    return w


def area(score, y):
    a, b = score[y == 1], score[y == 0]
    return ((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b)) if len(a) and len(b) else None


def test_models_fitted_together(rows, data):
    x, y = data
    models = [classify.Model("a", lo, hi, 0, train, c) for lo, hi in ((0, P), (2, 5)) for train in ((0, 1), (2,)) for c in (0.01, 1.0, 1e6)]
    got = classify.fit(rows.withColumn("member", F.array("g")), "x", "y", "member", models)
    for m, w in zip(models, got, strict=True):
        at = np.isin(np.arange(400) % 3, m.train)
        assert np.allclose(w, newton(x[at][:, m.start : m.stop], y[at], m.c), atol=1e-6)


def test_classes_that_separate_converge(spark):
    rows = spark.createDataFrame([(i, [float(i - 20) * 50], int(i > 19), [0]) for i in range(40)], "id long, x array<double>, y int, member array<int>")
    (w,) = classify.fit(rows, "x", "y", "member", [classify.Model("a", 0, 1, 0, (0,), 100.0)])
    assert np.isfinite(w).all() and w[1] > 0


def test_one_class_no_rows_and_nulls(spark, rows):
    one = rows.where("y = 1").withColumn("member", F.array("g"))
    assert classify.fit(one, "x", "y", "member", [classify.Model("a", 0, P, 0, (0,), 1.0)]) == [None]
    assert classify.fit(one.limit(0), "x", "y", "member", [classify.Model("a", 0, P, 0, (0,), 1.0)]) == [None]
    odd = rows.withColumn("member", F.array("g"))
    more = odd.union(odd.limit(9).withColumn("y", F.lit(None).cast("int"))).union(odd.limit(9).withColumn("x", F.lit(None).cast("array<double>")))
    m = [classify.Model("a", 0, P, 0, (0, 1, 2), 1.0)]
    assert np.allclose(classify.fit(more, "x", "y", "member", m)[0], classify.fit(odd, "x", "y", "member", m)[0])


def test_areas(spark):
    """Ties within and across ranges, groups of one class, null scores; a bootstrap is about its own area."""
    rng = np.random.default_rng(1)
    score = np.round(rng.standard_normal(3000) * 3) / 3
    y = (score + rng.standard_normal(3000) > 0).astype(int)
    g = np.arange(3000) % 3
    y[g == 2] = 1
    df = spark.createDataFrame([(int(a), int(i), float(s), int(t)) for i, (a, s, t) in enumerate(zip(g, score, y, strict=True))] + [(0, 1, None, 1)], "g int, h long, score double, y int")
    df = df.withColumn("h", F.xxhash64("h")).repartition(7)
    got = {r["g"]: r for r in classify.areas(df, ["g"], 200).collect()}
    for k in (0, 1):
        want = area(score[g == k], y[g == k])
        assert got[k]["n"] == 1000 and got[k]["n_pos"] == y[g == k].sum() and abs(got[k]["auc"] - want) < 1e-12
        assert got[k]["lo"] < want < got[k]["hi"] and got[k]["hi"] - got[k]["lo"] < 0.08
    assert got[2]["auc"] is None and got[2]["lo"] is None
    assert classify.areas(df.limit(0), ["g"], 10).collect() == []
    again = {r["g"]: r for r in classify.areas(df.repartition(3), ["g"], 200).collect()}
    assert all(abs(again[k]["lo"] - got[k]["lo"]) < 1e-12 for k in (0, 1))


def test_nested_members(rows):
    got = classify.nested_members(rows, "id", "y", 5, 3, 42).collect()
    for y in (0, 1):
        mine = [r for r in got if r["y"] == y]
        sizes = np.bincount([r["fold"] for r in mine], minlength=5)
        assert sizes.max() - sizes.min() <= 1
        for k in range(5):
            assert all((r["member"][k] == -1) == (r["fold"] == k) for r in mine)
            inner = np.bincount([r["member"][k] for r in mine if r["fold"] != k], minlength=3)
            assert inner.max() - inner.min() <= 1


def test_nested_cross_validation(rows, data):
    """Every choice and area as a plain nested loop over projected blocks gives them."""
    x, y = data
    basis = np.linalg.qr(np.random.default_rng(2).standard_normal((P, 2)))[0]
    folds = classify.nested(rows, "id", "x", "y", basis, (0.01, 1.0), 3, 2, 7, 50)
    member = {r["id"]: r["member"] for r in classify.nested_members(rows, "id", "y", 3, 2, 7).collect()}
    inner = np.array([member[i] for i in range(len(x))])
    blocks = {"full": x, "coupled": x @ basis @ basis.T, "uncoupled": x - x @ basis @ basis.T}
    got = {(r["condition"], r["fold"]): r for r in folds.collect()}
    assert len(got) == 9
    score = lambda w, b: b @ w[1:] + w[0]
    for name, b in blocks.items():
        for k in range(3):
            means = {}
            for c in (0.01, 1.0):
                parts = [(inner[:, k] == 1 - i, inner[:, k] == i) for i in range(2)]
                means[c] = np.mean([area(score(newton(b[t], y[t], c), b[v]), y[v]) for t, v in parts])
            best = max((0.01, 1.0), key=means.get)
            r, train, test = got[name, k], inner[:, k] >= 0, inner[:, k] < 0
            assert abs(r["inner_auc"] - means[r["c"]]) < 1e-9 and (r["c"] == best or abs(means[best] - means[r["c"]]) < 1e-9)
            assert abs(r["auc"] - area(score(newton(b[train], y[train], r["c"]), b[test]), y[test])) < 1e-9
            assert r["lo"] <= r["auc"] <= r["hi"] and r["n"] == test.sum()
    summary = {r["condition"]: r for r in classify.nested_summary(folds).collect()}
    aucs = [got["coupled", k]["auc"] for k in range(3)]
    assert np.isclose(summary["coupled"]["mean_auc"], np.mean(aucs)) and np.isclose(summary["coupled"]["sd_auc"], np.std(aucs))
    assert np.isclose(summary["coupled"]["diff_to_full"], np.mean([got["coupled", k]["auc"] - got["full", k]["auc"] for k in range(3)])) and summary["full"]["diff_to_full"] == 0


def test_grid(rows, data):
    x, y = data
    got = {(r["feature_set"], r["c"], r["dataset"]): r for r in classify.grid(rows, "id", "x", "y", "g", {"all": (0, P), "first": (0, 2)}, (0.01, 1.0), replicates=20).collect()}
    assert len(got) == 8
    g = np.arange(400) % 3
    for (name, c, s), r in got.items():
        b = x[:, : P if name == "all" else 2]
        w = newton(b[g == 0], y[g == 0], c)
        assert abs(r["auc"] - area(b[g == s] @ w[1:], y[g == s])) < 1e-9
        assert r["chosen"] == (got[name, c, 1]["auc"] >= max(got[name, d, 1]["auc"] for d in (0.01, 1.0)))
