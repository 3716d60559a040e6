"""Operators on small tables with known results."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.functions import ids
from covaria.functions import vectors as V
from covaria.operators import cohort, dynamics, geometry, inference, models, moments, results, spd, splits, transforms
from covaria.sources import readers, writers
from covaria.streaming import dynamics as streams


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_alignment(spark):
    t = lambda names: table(spark, [(c,) for c in names], "id string")
    sets = {"gm": t("abcd"), "fnc": t("bcde"), "cov": t("bc")}
    assert sorted(r[0] for r in cohort.align(sets).collect()) == ["b", "c"]
    reasons = {r["reason"]: r["n"] for r in cohort.drop_reasons(cohort.presence(sets), list(sets)).collect()}
    assert reasons == {"missing_gm": 1, "missing_fnc": 1, "missing_cov": 3}
    with pytest.raises(ValueError, match="repeated"):
        cohort.align({"a": t("aa"), "b": t("a")})
    with pytest.raises(KeyError):
        cohort.assert_all_found(t("xyz"), t("xy"))
    with pytest.raises(ValueError, match="both"):
        cohort.assert_disjoint(t("ab"), t("bc"))
    one = lambda names, d: cohort.alignment_hash(t(names), digits=d).first()["sha256"]
    assert all(one("abc", d) == one("cba", d) != one("abd", d) for d in (0, 1, 2))
    assert one("ab", 0) == hashlib.sha256(b"a|b").hexdigest()


def test_ids(spark):
    df = table(spark, [(" Sub_01-X ",), ("sub_01",)], "s string").select("s", ids.normalize_id(F.col("s"), lower=True, prefix="sub_", suffix="-x").alias("n"))
    assert [r["n"] for r in df.collect()] == ["01", "01"]
    with pytest.raises(ValueError, match="collide"):
        ids.assert_no_collisions(df, "s", "n")
    assert ids.edges(spark, 53).count() == 1378


def test_vectors(spark):
    m = np.arange(16.0).reshape(4, 4)
    df = table(spark, [(m.ravel().tolist(),)], "m array<double>")
    assert df.select(V.upper_triangle(F.col("m"), 4)).first()[0] == m[np.triu_indices(4, 1)].tolist()
    with pytest.raises(Exception, match="not a 5 x 5"):
        df.select(V.upper_triangle(F.col("m"), 5)).collect()
    back = table(spark, [([1.0, 2.0, 3.0],)], "e array<double>").select(V.full_matrix(F.col("e"), 3)).first()[0]
    assert back == [1, 1, 2, 1, 1, 3, 2, 3, 1]
    z = table(spark, [([-1.0, -0.9999999, 0.0, 0.9999999, 1.0],)], "r array<double>").select(V.fisher_z(F.col("r")).alias("z"), V.clipped(F.col("r")).alias("n")).first()
    assert np.isfinite(z["z"]).all() and z["n"] == 4 and z["z"][2] == 0
    assert table(spark, [([1.0, float("nan")],), ([1.0, None],), ([1.0, 2.0],)], "x array<double>").select(V.finite(F.col("x"))).collect() == [(False,), (False,), (True,)]


def test_splits(spark):
    rows = table(spark, [(f"s{i}", i % 2) for i in range(100)], "id string, g int")
    split = splits.stratified_split(rows, "id", "g")
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts["test"] == 16 and counts["val"] == 14 and sum(counts.values()) == 100
    assert splits.split_proof(split).first()["no_overlap"]
    assert split.subtract(splits.stratified_split(rows.repartition(7), "id", "g")).count() == 0
    with pytest.raises(ValueError):
        splits.stratified_split(rows, "id", "g", 0.9, 0.2)
    assert {r["count"] for r in splits.folds(rows, "id", 5).groupBy("fold").count().collect()} == {20}
    assert splits.stratified_subsample(rows, "id", "g", 10).count() == 10
    assert [r["row_idx"] for r in splits.with_row_index(rows, ["id"]).orderBy("id").collect()] == list(range(100))
    times = splits.multiplicities(rows, "id", 200)
    assert abs(times.agg(F.sum("times")).first()[0] / 20_000 - 1) < 0.05


def test_quantiles(spark):
    values = [float(v) for v in np.random.default_rng(1).integers(0, 40, 300)] + [None, None]
    df = table(spark, [(v,) for v in values], "v double")
    probs = [0.0, 0.1, 0.5, 0.975, 1.0]
    assert np.allclose(splits.quantiles(df, "v", probs), np.quantile(values[:-2], probs))
    assert splits.quantiles(df.where("v IS NULL"), "v", [0.5]) == [None] and splits.quantiles(df.limit(1), "v", [0.3]) == [values[0]]


def test_linear_map(spark):
    df = table(spark, [(1, [1.0, 2.0], "k"), (2, None, "l"), (3, [0.5, -1.0], None)], "id long, x array<double>, other string")
    b = np.array([[1.0, 0.0, 2.0], [3.0, -1.0, 0.5]])
    got = {r["id"]: r for r in moments.linear_map(df, "x", b, np.array([0.0, 1.0, 0.0]), "x").collect()}
    assert got[1]["x"] == [7.0, -1.0, 3.0] and got[2]["x"] is None and got[3]["x"] == [-2.5, 2.0, 0.5] and got[2]["other"] == "l"
    assert moments.linear_map(df.where("id = 2"), "x", b).first()["mapped"] is None and moments.linear_map(df.limit(0), "x", b).count() == 0


def test_means_of_matrices(spark):
    rng = np.random.default_rng(3)
    found = [a @ a.T + np.eye(3) for a in rng.normal(size=(20, 3, 3))]
    df = table(spark, [(m.ravel().tolist(),) for m in found] + [(None,)], "m array<double>")
    logs = [(v * np.log(w)) @ v.T for w, v in map(np.linalg.eigh, found)]
    w, v = np.linalg.eigh(np.mean(logs, axis=0))
    assert np.allclose(spd.log_euclidean_mean(df, "m"), (v * np.exp(w)) @ v.T)
    assert spd.frechet_mean(df, "m").shape == (3, 3)
    with pytest.raises(ValueError, match="no matrix"):
        spd.frechet_mean(df.where("m IS NULL"), "m")


def test_dynamics_with_buckets(spark):
    rng = np.random.default_rng(0)
    rows = [(int(u), i, i // 7, "abc"[rng.integers(3)]) for u in range(3) for i in range(int(rng.integers(1, 60)))]
    seq = table(spark, rows, "u long, t long, day long, s string")
    plain = dynamics.transitions(seq, "u", ["t"], "s")
    assert plain.exceptAll(dynamics.transitions(seq, "u", ["t"], "s", F.col("day"))).count() == 0
    whole, stitched = (dynamics.runs(seq, "u", ["t"], "s", b).collect() for b in (None, F.col("day")))
    assert sum(r["length"] for r in whole) == len(rows) and set(whole) == set(stitched) and len(whole) == len(stitched)
    odd = table(spark, [(None, 0, 0, "a"), (None, 1, 1, "a"), (1, 0, 0, None), (1, 1, 1, None), (1, 2, 2, "b")], "u long, t long, day long, s string")
    assert set(dynamics.runs(odd, "u", ["t"], "s", F.col("day")).collect()) == set(dynamics.runs(odd, "u", ["t"], "s").collect())
    wide = dynamics.subject_summary(table(spark, [(1, 0, "a")], "u long, t long, s string"), "u", ["t"], "s", ["a", "b"]).first()
    assert wide["occ_0"] == 1 and wide["dwell_1"] == 0 and wide["switching_rate"] == 0 and wide["tc_0_1"] == 0


def test_design(spark):
    first = table(spark, [("a", 1.0, "M", "S1", True), ("b", 3.0, None, "S1", True), ("c", None, "F", "S0", False)], "id string, age double, g string, site string, train boolean")
    second = table(spark, [("x", None, "X", "S2"), ("y", 5.0, "M", "S1")], "id string, age double, g string, site string")
    d = transforms.fit_design(first.where("train"), ["age"], ["g", "site"])
    assert d.names() == ["intercept", "age", "g=__MISSING__"] and d.levels == {"g": ["M", "__MISSING__"], "site": ["S1"]}
    got = {r["id"]: r["design"] for r in d.apply(second).collect()}
    assert got["x"][:2] == [1.0, 2.0] and [r["level"] for r in d.unseen(second, "site").collect()] == ["S2"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((400, 12))
    b = rng.standard_normal((12, 3)) @ rng.standard_normal((3, 9))
    y = x @ b + rng.standard_normal((400, 9)) * 0.5 + 2.0
    rows = [(i, x[i].tolist(), y[i].tolist(), ["train", "val", "test"][(i % 10 > 6) + (i % 10 > 7)]) for i in range(400)]
    return x, y, b, spark.createDataFrame(rows, "id long, x array<double>, y array<double>, split string").repartition(5)


def test_moments(planted):
    x, y, _, df = planted
    s = moments.stats(df, "x", "y")
    assert np.allclose(s.xy, x.T @ y) and np.allclose(s.yy, y.T @ y) and np.isclose(s.n, 400)
    assert np.allclose(s.correlation(), np.corrcoef(x.T, y.T)[:12, 12:])
    weighted = moments.stats(df.withColumn("w", F.lit(2.0)), "x", "y", weight="w")
    assert np.allclose(weighted.xx, 2 * x.T @ x) and np.isclose(weighted.n, 800)


def test_models(planted, spark):
    x, y, b, df = planted
    s = moments.stats_by(df, "x", "y", ["split"])
    train, val, test = s["train",], s["val",], s["test",]
    at = np.array([i % 10 > 7 for i in range(400)])
    fit = models.ridge(train, val)
    pred = x[at] @ fit.b + fit.intercept
    assert np.isclose(models.r2(test, fit.b, fit.intercept), 1 - ((y[at] - pred) ** 2).sum() / ((y[at] - y[at].mean()) ** 2).sum())
    for name in models.METHODS:
        assert models.r2(test, (f := models.fit(name, train, val)).b, f.intercept) > (0.5 if name == "nuclear_norm" else 0.9), name
    assert 3 <= models.reduced_rank(train, val).chosen <= 9
    full = models.pls(train, train, [12])
    cxx, cxy, _ = train.centered()
    assert np.allclose(full.b, np.linalg.solve(cxx, cxy), atol=1e-6)
    assert np.isclose(models.noise_median(1.0), 0.6528, atol=1e-3) and np.linalg.matrix_rank(models.shrunk(b + 0.01)) <= 9
    mean, axes = models.components(train, 3)
    t = (y[at] - mean) @ axes
    e = t - (pred - mean) @ axes
    assert np.allclose(models.component_r2(test, fit, mean, axes), 1 - (e**2).sum(axis=0) / ((t - t.mean(axis=0)) ** 2).sum(axis=0))
    got = {r["id"]: r["prediction"] for r in models.predict(df, "x", fit).collect()}
    assert np.allclose([got[i] for i in range(400)], x @ fit.b + fit.intercept)
    with pytest.raises(ValueError, match="unknown method"):
        models.fit("magic", train, val)


def test_residuals(planted):
    x, y, _, df = planted
    df = df.withColumn("design", F.array(F.lit(1.0), F.get("x", F.lit(0)), F.lit(1.0)))  # a repeated intercept: least norm
    beta = transforms.fit_ols(df, "design", "y")
    got = {r["id"]: r["y"] for r in transforms.residualize(df, "design", "y", beta).collect()}
    d = np.c_[np.ones(400), x[:, 0]]
    want = y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
    assert np.allclose([got[i] for i in range(400)], want)


def test_geometry():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((20, 6)))[0]
    assert np.isclose(geometry.overlap(q[:, :3], q[:, :3]), 1) and np.isclose(geometry.overlap(q[:, :3], q[:, 3:]), 0)
    assert np.allclose(geometry.principal_angles(q[:, :2], q[:, 2:4]), 90)
    d = np.array([4.0, 2.0, 1.0, 1e-9])
    assert geometry.effective_rank(d) == 3 and geometry.select_rank(d, "energy:0.9") == 2 and geometry.select_rank(d, "fixed:9") == 4 and geometry.select_rank(d, 0.99) == 3
    assert np.isclose(geometry.participation_ratio(np.ones(5)), 5) and np.isclose(geometry.entropy_rank(np.ones(5)), 5)
    r = np.linalg.qr(np.random.default_rng(2).standard_normal((6, 6)))[0]
    assert np.allclose(q @ r @ geometry.procrustes(q, q @ r), q)
    assert [p[:2] for p in geometry.align_modes(q, -q[:, [1, 0, 2, 3, 4, 5]])][0][0] in range(6)


def check_groups(spark, df, s):
    """Group scores, tier null, intervals and the rank test against plain NumPy on the same rows."""
    fitted = models.ridge(s["train",], s["val",])
    rows = df.where("split = 'test'").orderBy("id").collect()
    x, y = (np.array([r[c] for r in rows]) for c in "xy")
    told, groups = x @ fitted.b + fitted.intercept, {"a": [0, 1, 2, 3], "b": list(range(y.shape[1]))}
    got = inference.group_scores(s["test",], fitted, groups, [2])
    for r in got:
        at = groups[r["group"]]
        axes = [np.linalg.svd(m[:, at] - m[:, at].mean(axis=0), full_matrices=False)[2][:2].T for m in (y, told)]
        r2 = np.mean([1 - ((y[:, j] - told[:, j]) ** 2).sum() / ((y[:, j] - y[:, j].mean()) ** 2).sum() for j in at])
        assert r["overlap"] == pytest.approx(geometry.overlap(*axes), abs=1e-6) and r["r2"] == pytest.approx(r2, abs=1e-6)
    seen = spark.createDataFrame([(r["group"], r["k"], r["overlap"], r["r2"], r["ratio"]) for r in got], "group string, k long, overlap double, r2 double, ratio double")
    null = inference.tier_null(df.where("split = 'train'"), "id", "x", "y", s["test",], groups, [2], 1.0, 8)
    assert null.count() == 16
    margins = inference.margins(null, seen.select("group", "k", F.col("overlap").alias("observed")), "group", "k").collect()
    for r in margins:
        values = np.array([n["overlap"] for n in null.where(F.col("group") == r["group"]).collect()])
        assert r["null_sd"] == pytest.approx(values.std()) and r["margin"] == pytest.approx(r["observed"] - values.mean()) and r["p"] == pytest.approx(((values >= r["observed"]).sum() + 1) / 9)
    boot = inference.group_bootstrap(df.where("split = 'test'"), "id", "x", "y", fitted, groups, 2, 20)
    u = F.concat("x", "y")
    hashes = df.where("split = 'test'").orderBy("id").select(F.xxhash64(F.col("id").cast("string"), u, u).alias("h")).collect()
    at = np.repeat(np.arange(len(rows)), inference.drawn_times(np.array([r["h"] for r in hashes]), 3, 42).astype(int))
    r2 = np.mean([1 - ((y[at, j] - told[at, j]) ** 2).sum() / ((y[at, j] - y[at, j].mean()) ** 2).sum() for j in groups["a"]])
    assert boot.where("rep = 3 AND group = 'a'").first()["r2"] == pytest.approx(r2, abs=1e-6)
    for r in inference.basic_intervals(boot, seen, ["overlap", "r2"]).collect():
        values = [b[r["value"]] for b in boot.where(F.col("group") == r["group"]).collect()]
        assert r["lo"] == pytest.approx(2 * r["observed"] - np.percentile(values, 97.5)) and r["hi"] == pytest.approx(2 * r["observed"] - np.percentile(values, 2.5))
    scrambled = inference.scrambled_component_null(df.where("split = 'train'"), "id", "x", "y", s["val",], s["test",], 2, 5)
    assert scrambled.agg(F.max("r2")).first()[0] < models.component_r2(s["test",], fitted, *models.components(s["train",], 2)).mean()
    ranks = inference.rank_test(df.where("split = 'test'"), "id", "x", "y", fitted.b, min(fitted.b.shape), 60).orderBy("rank").collect()
    u, d, v = np.linalg.svd(fitted.b, full_matrices=False)
    r2s = [1 - ((y - x @ (u[:, :k] * d[:k]) @ v[:k]) ** 2).sum() / ((y - y.mean()) ** 2).sum() for k in range(len(ranks) + 1)]
    assert np.allclose([r["gain"] for r in ranks], np.diff(r2s)) and np.allclose([r["cumulative"] for r in ranks], r2s[1:])
    marks = [r["significant"] for r in ranks]
    assert marks[0] and all(any(marks[i : i + 3]) for i in range(len(marks) - 3)) and (len(marks) == min(fitted.b.shape) or not any(marks[-3:]))


def test_inference(planted, spark):
    _, _, b, df = planted
    s = moments.stats_by(df, "x", "y", ["split"])
    v = geometry.right_subspace(models.ridge(s["train",], s["val",]).b, 3)
    truth = geometry.right_subspace(b, 3)
    told = inference.null_summary(inference.haar_null(spark, v, 3, 200), "overlap", geometry.overlap(v, truth)).first()
    assert told["p"] == pytest.approx(1 / 201) and told["mean"] == pytest.approx(3 / 9, abs=0.05)
    broken = inference.broken_pairs(df, "id", "x", "y", 3)
    assert broken.count() == 1200 and broken.select("rep", "x").distinct().count() == 1200
    null = inference.break_pairing_null(df, "id", "x", "y", truth, 3, 1.0, 5)
    assert null.agg(F.max("overlap")).first()[0] < geometry.overlap(v, truth)
    boot = inference.bootstrap_singular_values(df, "id", "x", "y", 2, 10).groupBy("idx").agg(F.avg("sigma").alias("m")).orderBy("idx").collect()
    assert np.allclose([r["m"] for r in boot], np.linalg.svd(moments.stats(df, "x", "y").xy, compute_uv=False)[:2], rtol=0.1)
    check_groups(spark, df, s)
    lo, hi = results.bca_interval([1.0, 2.0, 3.0, 4.0, 9.0])
    assert lo < 3.8 < hi


def test_spd(spark):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((40, 5, 8))
    m = a @ a.transpose(0, 2, 1) / 8
    df = table(spark, [(i, x.ravel().tolist()) for i, x in enumerate(m)], "id long, m array<double>")
    for metric in spd.METRICS:
        base = spd.frechet_mean(df, "m") if metric == "airm" else spd.log_euclidean_mean(df, "m")
        t = df.withColumn("t", spd.tangent(F.col("m"), base, metric))
        back = {r["id"]: r["b"] for r in t.select("id", spd.from_tangent(F.col("t"), base, metric).alias("b")).collect()}
        assert np.allclose([back[i] for i in range(40)], m.reshape(40, -1))
        assert np.allclose(np.mean([r["t"] for r in t.collect()], axis=0), 0, atol=1e-4)
    d = df.select(*[spd.distance(F.col("m"), F.col("m"), k).alias(k) for k in (*spd.METRICS, "bures")], spd.is_spd(F.col("m")).alias("ok")).collect()
    assert all(r["ok"] and max(r[:3]) < 1e-6 for r in d)
    bad = table(spark, [([1.0, 2.0, 2.0, 1.0],)], "m array<double>")
    assert not bad.select(spd.is_spd(F.col("m"))).first()[0] and bad.select(spd.is_spd(spd.make_spd(F.col("m")))).first()[0]
    with pytest.raises(ValueError, match="unknown metric"):
        spd.tangent(F.col("m"), np.eye(2), "logE")


def test_sources(spark, tmp_path):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((12, 10))
    lines = ["SubjectID\t" + "\t".join(f"gm_{j}" for j in range(10))] + [f"sub_{i:03d}\t" + "\t".join(map(str, x[i])) for i in range(12)]
    lines.append("sub_012\t" + "\t".join(["nan"] * 10))
    (tmp_path / "gm.tsv").write_text("\n".join(lines))
    got = readers.feature_vectors(readers.read_table(spark, str(tmp_path / "gm.tsv")), "SubjectID")
    assert got.count() == 12 and np.allclose({r["id"]: r["x"] for r in got.collect()}["sub_003"], x[3])
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "b.npz", one=x)
    for name in ("a.npy", "b.npz"):
        rows = readers.read_matrix(spark, str(tmp_path / name)).orderBy("row").collect()
        assert np.allclose([r["values"] for r in rows], x)
    with pytest.raises(ValueError, match="no reader"):
        readers.discover_format("x.mat")
    with pytest.raises(KeyError):
        readers.infer_column(["a"], None, ["b", "c"])
    ids_ = table(spark, [(f"s{i}", i) for i in range(12)], "id string, row_idx long")
    assert readers.with_ids(readers.read_matrix(spark, str(tmp_path / "a.npy")), ids_).count() == 12
    table(spark, [(1, 2.0, "OK "), (2, 3.0, "bad"), (1, 4.0, "ok")], "id long, v double, status string").repartition(2).write.parquet(str(tmp_path / "chunks"))
    assert readers.read_chunks(spark, str(tmp_path / "chunks")).count() == 1
    paths = table(spark, [("a", str(tmp_path / "a.npy")), ("b", str(tmp_path / "gm.tsv"))], "id string, p string")
    good, bad = readers.decoded(paths, "id", "p", lambda c: __import__("numpy").load(__import__("io").BytesIO(c)).ravel()[:3])
    assert good.count() == 1 and bad.count() == 1
    cov = readers.load_covariates(table(spark, [("a", "1"), ("b", "x"), ("c", "5")], "id string, age string"), table(spark, [("a",), ("b",), ("z",), ("c",)], "id string"), ["age"])
    assert {r["id"]: r["age"] for r in cov.collect()} == {"a": 1.0, "b": 3.0, "z": 3.0, "c": 5.0}
    z = readers.fisher_z_vectors(table(spark, [("a", [0.5, -0.2]), ("b", [3.0, 2.0])], "id string, y array<double>"))
    assert {r["id"]: r["applied"] for r in z.collect()} == {"a": True, "b": False}


def test_writers(spark, tmp_path):
    blocks = table(spark, [("ds1", "raw", "x", "a", [1.0]), ("ds1", "resid", "x", "a", [2.0])], "dataset string, variant string, block string, id string, values array<double>")
    writers.write_blocks(blocks, str(tmp_path / "blocks"))
    assert readers.variant(spark.read.parquet(str(tmp_path / "blocks")), "raw").first()["values"] == [1.0]
    wide = table(spark, [("ridge", 0.5, 0.25)], "method string, r2 double, pc double")
    tidy = writers.tidy(wide, ["method"], ["r2", "pc"])
    assert tidy.count() == 2
    writers.append_rows(tidy, str(tmp_path / "log"))
    writers.append_rows(tidy, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4 and writers.latest(spark.read.parquet(str(tmp_path / "log")), ["method", "metric"], "value").count() == 2
    writers.write_json(wide, str(tmp_path / "j"))
    (part,) = (tmp_path / "j").glob("*.json")
    assert json.loads(part.read_text())["r2"] == 0.5
    writers.write_tsv(wide, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 1
    assert "| ridge | 0.5 | 0.25 |" in writers.audit_report({"scores": wide})
    b = writers.coefficient_table(spark, "ridge", 1, np.eye(2))
    assert b.count() == 4 and writers.missing_fits(table(spark, [("ridge", 1), ("rrr", 1)], "method string, seed long"), b).count() == 1


def test_contracts(spark):
    t = lambda names, n=2: table(spark, [(c, [0.0] * n) for c in names], "id string, v array<double>")
    ok = {"x1": t("ab"), "y1": t("ab", 3), "x2": t("cd"), "y2": t("cd", 3)}
    split = table(spark, [("a", "train"), ("b", "test")], "id string, split string")
    assert set(readers.load_contracts(ok, split)) == {"x1", "y1", "x2", "y2", "splits"}
    for change in ({"x2": t("ad"), "y2": t("ad", 3)}, {"x2": t("cd", 5)}, {"y1": t("a", 3)}):
        with pytest.raises((ValueError, KeyError)):
            readers.load_contracts(ok | change, split)


def test_streams(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    counted = streams.windowed_counts(stream(), "user_id", "ts", "event_type")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == source.count()
    q = streams.transitions(stream(), "user_id", "ts", "event_type").writeStream.outputMode("append").format("memory").queryName("moved").start()
    q.processAllAvailable()
    q.stop()
    want = dynamics.transitions(source, "user_id", ["ts", "event_id"], "event_type").agg(F.sum("n")).first()[0]
    assert spark.table("moved").agg(F.sum("n")).first()[0] == want


def test_prepare(spark, sf_dir):
    from covaria.operators import preprocess
    from covaria.plans import suites

    done = suites.cohorts(spark, sf_dir)
    assert done.removed > 0 and preprocess.verify(done.rows).first()["passed"] and preprocess.verify(done.rows.union(done.rows)).first()["n_repeated"] == done.rows.count()
    train = done.rows.where("dataset = 'ds1' AND split = 'train'").select(F.posexplode("y").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in train.collect())


def test_atlas(spark):
    from covaria.operators import atlas

    v = table(spark, [(1, 1, 2.0), (1, 2, 4.0), (1, 3, float("nan")), (2, 1, None)], "s long, voxel long, v double")
    w = table(spark, [(1, 0, 1.0), (2, 0, 3.0), (3, 0, 5.0), (2, 1, 0.05), (1, 2, 0.0)], "voxel long, region long, w double")
    assert [tuple(r) for r in atlas.region_means(v, w, "s", threshold=0.1).collect()] == [(1, 0, 3.5)]
    rng = np.random.default_rng(0)
    maps, x = rng.standard_normal((30, 3)), rng.standard_normal(30)
    got = table(spark, [(x.tolist(),)], "x array<double>").select(atlas.loadings(F.col("x"), atlas.projector(maps))).first()[0]
    m = maps - maps.mean(axis=0)
    assert np.allclose(got, np.linalg.lstsq(m / np.linalg.norm(m, axis=0), x - x.mean(), rcond=None)[0])
