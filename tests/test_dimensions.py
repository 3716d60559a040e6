"""Resampled products against products of rows drawn alike; ladders, ratios and floors on planted couplings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.operators import dimensions, inference, moments

N, P, Q = 600, 5, 8


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(21)
    u = rng.standard_normal((N, 2))
    x = u @ rng.standard_normal((2, P)) + rng.standard_normal((N, P))
    return x, u @ rng.standard_normal((2, Q)) + rng.standard_normal((N, Q)), rng.standard_normal((N, 2))


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, c = data
    return spark.createDataFrame([(i, x[i].tolist(), y[i].tolist(), c[i].tolist(), i % 2, i % 3) for i in range(N)], "id long, x array<double>, y array<double>, c array<double>, cohort int, site int").repartition(5)


def told(df, **options):
    return {r["rep"]: r for r in inference.by_products(df, lambda by: [{"n": p.n, "sx": p.sx.tolist(), "sy": p.sy.tolist(), "xx": p.xx.tolist(), "yy": p.yy.tolist(), "xy": p.xy.ravel().tolist()} for p in by.values()], "n double, sx array<double>, sy array<double>, xx array<double>, yy array<double>, xy array<double>", **options).collect()}


@pytest.mark.parametrize("block", [64, 4096])
def test_broken_pairs_keep_margins(rows, data, block):
    """Sums and squares of each side stay; x'y changes; the same replicates come whatever the partitions."""
    x, y, _ = data
    got = told(inference.resampled_products(rows, "id", "x", "y", 30, 5, block=block, at_once=7, observed=True))
    assert sorted(got) == list(range(-1, 30))
    assert np.allclose(got[-1]["xy"], (x.T @ y).ravel())
    for r in got.values():
        assert r["n"] == N and np.allclose(r["sx"], x.sum(axis=0)) and np.allclose(r["sy"], y.sum(axis=0)) and np.allclose(r["xx"], (x**2).sum(axis=0)) and np.allclose(r["yy"], (y**2).sum(axis=0))
    mean = np.mean([got[r]["xy"] for r in range(30)], axis=0)
    chance = np.outer(x.sum(axis=0), y.sum(axis=0)).ravel() / N
    assert np.abs(mean - chance).max() < 5 * np.abs(x).max() * np.abs(y).max() * np.sqrt(N / 30)
    assert np.linalg.norm(mean - chance) < 0.2 * np.linalg.norm((x.T @ y).ravel() - chance)
    again = told(inference.resampled_products(rows.repartition(3), "id", "x", "y", 30, 5, block=block, at_once=50))
    assert all(np.allclose(again[r]["xy"], got[r]["xy"]) for r in range(30))


def test_broken_pairs_stay_in_their_stratum(rows, data):
    x, y, _ = data
    flat = rows.withColumn("x", F.array((F.col("site") == 0).cast("double"), (F.col("site") == 1).cast("double"))).withColumn("y", F.col("x"))
    got = told(inference.resampled_products(flat, "id", "x", "y", 5, stratum="site"))
    assert all(r["xy"] == [200.0, 0.0, 0.0, 200.0] for r in got.values())


def test_bootstrap_products(rows, data):
    """Draws are those of drawn_times; nulls, equal rows and an empty table are defined."""
    x, y, _ = data
    got = told(inference.resampled_products(rows, "id", "x", "y", 40, 3, "bootstrap", at_once=9))
    h = np.array([r["h"] for r in rows.select("id", F.xxhash64(F.col("id").cast("string"), "x", "y").alias("h")).orderBy("id").collect()])
    for r in (0, 17, 39):
        w = inference.drawn_times(h, r, 3)
        assert got[r]["n"] == w.sum() and np.allclose(got[r]["xy"], ((x * w[:, None]).T @ y).ravel()) and np.allclose(got[r]["yy"], w @ y**2)
    every = np.concatenate([inference.drawn_times(h, r, 3) for r in range(40)])
    assert abs(every.mean() - 1) < 0.03 and abs(every.var() - 1) < 0.05
    odd = rows.union(rows.limit(3).withColumn("x", F.lit(None).cast("array<double>")))
    assert np.allclose(told(inference.resampled_products(odd, "id", "x", "y", 1, 3, "bootstrap"))[0]["xy"], got[0]["xy"])
    for how in ("bootstrap", "break", "halves"):
        assert told(inference.resampled_products(rows.limit(0), "id", "x", "y", 2, 3, how)) == {}
    same = rows.withColumn("id", F.lit(None).cast("long")).where("site = 0").unionByName(rows.where("site > 0"))
    assert told(inference.resampled_products(same, "id", "x", "y", 2, block=32))[1]["n"] == N


def test_cells_of_equal_rows_are_cut(rows, data):
    """All rows alike: one hash, one cell, drawn from in pieces."""
    flat = rows.select(F.lit(1).alias("id"), F.array(F.lit(2.0)).alias("x"), F.array(F.lit(3.0)).alias("y"))
    got = told(inference.resampled_products(flat, "id", "x", "y", 2, block=16))
    assert got[0]["n"] == N and got[0]["xy"] == [6.0 * N]


def test_halves_are_disjoint(rows):
    one_hot = rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda k: (k == F.col("id")).cast("double")).alias("x")).withColumn("y", F.array(F.lit(1.0)))
    for how in ("halves", "broken_halves"):
        products = inference.resampled_products(one_hot, "id", "x", "y", 2, how=how, share=0.3, block=128)
        got = inference.by_products(products, lambda by: [{"a": by[0,].sx.tolist(), "b": by[1,].sx.tolist()}], "a array<double>, b array<double>", "half").collect()
        for r in got:
            a, b = np.array(r["a"]), np.array(r["b"])
            assert a.max() == b.max() == 1 and (a * b).sum() == 0 and abs(a.sum() - 180) <= 3 and a.sum() == b.sum()


def test_ladder(rows, data):
    """The last rung is all rows; each draw takes strata by their share; residuals are refits'."""
    x, y, c = data
    got = dimensions.ladder(rows, "id", "x", "y", 100, "site")
    assert [r["n"] for r in got][-1] == N and all(abs(r["n"] - w) <= 3 for r, w in zip(got, (100, 200, 400, 600), strict=True))
    cov = (x - x.mean(axis=0)).T @ (y - y.mean(axis=0)) / N
    d = np.linalg.svd(cov, compute_uv=False)
    assert np.allclose(got[-1]["sigma"], d) and np.isclose(got[-1]["participation_ratio"], (d**2).sum() ** 2 / (d**4).sum()) and np.isclose(dimensions.participation(cov), got[-1]["participation_ratio"])
    p = d / d.sum()
    assert np.isclose(got[-1]["entropy_rank"], np.exp(-(p * np.log(p)).sum())) and 1 <= got[-1]["threshold_rank"] <= 5
    design = np.column_stack([np.ones(N), c])
    left = lambda z: z - design @ np.linalg.lstsq(design, z, rcond=None)[0]
    clean = dimensions.ladder(rows, "id", "x", "y", 100, "site", "c")
    assert np.allclose(clean[-1]["sigma"], np.linalg.svd(left(x).T @ left(y) / N, compute_uv=False))
    assert dimensions.ladder(rows.limit(0), "id", "x", "y", 100) == [] and [r["n"] for r in dimensions.ladder(rows, "id", "x", "y", 5000)] == [N]
    nested = {r["n"]: r for r in dimensions.ladder(rows, "id", "x", "y", 75)}
    assert set(nested) == {75, 150, 300, 600}


def test_participation_test(rows, data, spark):
    """A coupling planted in two of many like dimensions lies below broken pairs; its interval covers it. Without one p is not small."""
    x, y, _ = data
    r = dimensions.participation_test(rows, "id", "x", "y", 20).first()
    assert np.isclose(r["observed"], dimensions.participation((x - x.mean(axis=0)).T @ (y - y.mean(axis=0)))) and r["n"] == N
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((8000, P)), rng.standard_normal((8000, Q))
    b[:, 0], b[:, 1] = 0.9 * a[:, 0] + 0.4 * b[:, 0], 0.45 * a[:, 1] + 0.9 * b[:, 1]
    planted = (0.9**2 + 0.45**2) ** 2 / (0.9**4 + 0.45**4)
    one = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(8000)], "id long, x array<double>, y array<double>")
    r = dimensions.participation_test(one, "id", "x", "y", 150).first()
    assert r["basic_lo"] < planted < r["basic_hi"] and r["boot_lo"] < r["observed"] < r["boot_hi"] < r["null_lo"] <= r["null_mean"] and r["p"] < 0.02 and r["disjoint"]
    rng = np.random.default_rng(4)
    noise = spark.createDataFrame([(i, rng.standard_normal(P).tolist(), rng.standard_normal(Q).tolist()) for i in range(300)], "id long, x array<double>, y array<double>")
    r = dimensions.participation_test(noise, "id", "x", "y", 60).first()
    assert r["p"] > 0.02 and not r["disjoint"]
    with pytest.raises(ValueError, match="no rows"):
        dimensions.participation_test(rows.limit(0), "id", "x", "y", 3)


def test_floors(rows, data):
    x, y, _ = data
    got = {r["k"]: r for r in dimensions.cohort_floor(rows, "id", "x", "y", "cohort", (1, 2, 9), 80).collect()}
    assert set(got) == {1, 2} and got[2]["above"] and got[2]["observed"] > 0.9 and got[2]["mean"] < 0.7
    z = [(lambda a, b: np.linalg.svd(np.corrcoef(a.T, b.T)[:P, P:], full_matrices=False)[0][:, :2])(x[k::2], y[k::2]) for k in (0, 1)]
    assert np.isclose(got[2]["observed"], ((z[0].T @ z[1]) ** 2).sum() / 2)
    assert dimensions.cohort_floor(rows.where("cohort = 0"), "id", "x", "y", "cohort", (1,), 3).collect() == []
    half = {(r["pairs"], r["k"]): r for r in dimensions.halves_floor(rows, "id", "x", "y", 150, (2,), 40).collect()}
    assert half["kept", 2]["p05"] > half["broken", 2]["mean"] and half["kept", 2]["n"] == 150
    with pytest.raises(ValueError, match="disjoint"):
        dimensions.halves_floor(rows, "id", "x", "y", 301)


def test_detectability(rows, data):
    x, y, _ = data
    got = dimensions.detectability(rows, "id", "x", "y", "site", 4, 60).collect()
    assert len(got) == 12
    for site in range(3):
        mine = sorted((r for r in got if r["site"] == site), key=lambda r: r["idx"])
        assert np.allclose([r["sigma"] for r in mine], np.linalg.svd(np.corrcoef(x[site::3].T, y[site::3].T)[:P, P:], compute_uv=False)[:4])
        assert mine[0]["detected"] and mine[1]["detected"] and not mine[3]["detected"]
