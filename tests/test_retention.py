"""Retention of centroids and of accuracy against plain versions; bootstraps against subjects drawn alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.operators import inference, models, retention

S, K, Q = 40, 3, 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    subject = rng.integers(0, S, 900)
    state = rng.integers(0, K, 900)
    w = rng.standard_normal((900, Q)) + rng.standard_normal((K, Q))[state] * 2 + rng.standard_normal((S, Q))[subject] / 2
    return subject, state, w, np.linalg.qr(rng.standard_normal((Q, 4)))[0]


@pytest.fixture(scope="module")
def windows(spark, data):
    subject, state, w, _ = data
    rows = [(f"s{subject[i]}", int(state[i]), w[i].tolist()) for i in range(len(w))] + [("s0", 7, [1.0] * Q), ("s1", None, [1.0] * Q), ("s1", 0, None)]
    return spark.createDataFrame(rows, "subject string, state int, w array<double>").repartition(5)


def centroids(state, w, weight):
    return np.array([np.average(w[state == k], axis=0, weights=weight[state == k]) if weight[state == k].sum() else np.zeros(Q) for k in range(K)])


MASKS = {"low": [0, 1, 2], "high": [4, 5], "none": []}


def rho_of(v, at, r, c):
    basis = np.linalg.qr(v[at][:, :r])[0]
    return ((c[:, at] @ basis) ** 2).sum(axis=1) / (c[:, at] ** 2).sum(axis=1)


def test_state_retention(spark, windows, data):
    subject, state, w, v = data
    got = {(r["tier"], r["r"], r["state"]): r for r in retention.state_retention(windows, "subject", "state", "w", K, v, (1, 2), MASKS, 40).collect()}
    assert len(got) == 3 * 2 * (K + 1)
    names = spark.createDataFrame([(f"s{i}",) for i in range(S)], "s string").select("s", F.xxhash64("s").alias("h")).collect()
    h = {r["s"]: r["h"] for r in names}
    hashes = np.array([h[f"s{i}"] for i in subject])
    for tier, at in (("all", list(range(Q))), ("low", [0, 1, 2]), ("high", [4, 5])):
        for r in (1, 2):
            want = rho_of(v, at, r, centroids(state, w, np.ones(len(w))))
            boot = np.array([rho_of(v, at, r, centroids(state, w, inference.drawn_times(hashes, b, 42))) for b in range(40)])
            for k in range(K):
                row = got[tier, r, k]
                assert np.isclose(row["rho"], want[k]) and np.isclose(row["chance"], min(r, len(at)) / len(at)) and np.isclose(row["lift"], want[k] / row["chance"]) and row["n_edges"] == len(at)
                assert np.allclose([row["boot_mean"], row["lo"], row["hi"]], [boot[:, k].mean(), *np.percentile(boot[:, k], [2.5, 97.5])])
            assert np.isclose(got[tier, r, -1]["rho"], want.mean()) and np.isclose(got[tier, r, -1]["lo"], np.percentile(boot.mean(axis=1), 2.5))
    assert retention.state_retention(windows.limit(0), "subject", "state", "w", K, v, (1,), None, 3).collect() == []


def test_differences(data):
    _, state, w, v = data
    c = centroids(state, w, np.ones(len(w)))
    got = retention.differences(c, v)
    assert [(r["state_a"], r["state_b"]) for r in got] == [(0, 1), (0, 2), (1, 2)]
    assert np.allclose([r["rho"] for r in got], rho_of(v, list(range(Q)), 4, np.array([c[1] - c[0], c[2] - c[0], c[2] - c[1]])))
    assert retention.differences(c[:1], v) == [] and retention.shares(v, np.zeros((1, Q))).tolist() == [0.0]


def test_local_overlaps(spark, windows, data):
    _, state, w, v = data
    got = {r["state"]: r for r in retention.local_overlaps(windows, "state", "w", v, 2).collect()}
    assert got[7]["n_windows"] == 1 and got[7]["k_local"] == 0 and got[7]["overlap"] is None
    for k in range(K):
        own = np.linalg.svd(w[state == k] - w[state == k].mean(axis=0), full_matrices=False)[2][:2].T
        assert np.isclose(got[k]["overlap"], ((own.T @ v[:, :2]) ** 2).sum() / 2) and np.isclose(got[k]["chance"], 2 / Q)


@pytest.fixture(scope="module")
def predicted():
    rng = np.random.default_rng(9)
    n, p, q = 260, 4, 6
    x = rng.standard_normal((n, p))
    b = rng.standard_normal((p, q))
    y = x @ b + rng.standard_normal((n, q))
    fits = {"good": models.Fit(b, np.zeros(q), 0, 0), "worse": models.Fit(b * 0.6, np.full(q, 0.1), 0, 0)}
    return x, y, fits, y.mean(axis=0), np.linalg.svd(y - y.mean(axis=0), full_matrices=False)[2][:3].T, np.array(["test", "external", "other"])[np.searchsorted([120, 240], np.arange(n), side="right")]


def test_accuracy_retention(spark, predicted):
    """Point values, paired differences and draws shared by all methods; rows of several seeds are averaged."""
    x, y, fits, mean, axes, part = predicted
    rows = spark.createDataFrame([(f"k{i}", x[i].tolist(), y[i].tolist(), str(part[i])) for i in range(len(x))], "id string, x array<double>, y array<double>, part string").repartition(4)
    errors = retention.component_errors(rows, "id", "x", "y", "part", fits, mean, axes)
    twice = errors.union(errors.withColumn("errors", F.transform("errors", lambda e: e * 3)))
    got = {(r["name"], r["measure"]): r for r in retention.accuracy_retention(twice, "id", "part", list(fits), [("good", "worse")], 50).collect()}
    assert len(got) == 2 * 3 + 2
    h = np.array([r["h"] for r in rows.select("id", F.xxhash64("id").alias("h")).orderBy(F.substring("id", 2, 9).cast("int")).collect()])
    truth = (y - mean) @ axes

    def r2(name, at, weight):
        f = fits[name]
        err = (truth - (x @ f.b + f.intercept - mean) @ axes) ** 2
        return (1 - weight[at] @ err[at] / (weight[at] @ truth[at] ** 2)).mean()

    boot = {k: [] for k in got}
    for b in range(-1, 50):
        weight = np.ones(len(x)) if b < 0 else inference.drawn_times(h, b, 42)
        one = {(n, d): r2(n, part == d, weight) for n in fits for d in ("test", "external")}
        one |= {(n, "retention"): one[n, "external"] / one[n, "test"] for n in fits} | {("good - worse", d): one["good", d] - one["worse", d] for d in ("test", "external")}
        for k in got:
            boot[k].append(one[k])
    for k, row in got.items():
        assert np.isclose(row["value"], boot[k][0]) and np.allclose([row["boot_mean"], row["lo"], row["hi"]], [np.mean(boot[k][1:]), *np.percentile(boot[k][1:], [2.5, 97.5])])
        assert row["p"] == np.mean(np.array(boot[k][1:]) <= 0)
