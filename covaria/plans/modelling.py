"""Queries on fitted maps, subspaces, nulls and matrices; most have no SQL and are held to NumPy by tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.functions import vectors as V
from covaria.operators import geometry, graphs, inference, metrics, models, moments, results, spd, splits
from covaria.plans.common import rounded, table, vectors
from covaria.plans.registry import query

TRAIN, VAL, TEST = "id % 10 < 7", "id % 10 = 7", "id % 10 > 7"


def parts(spark: SparkSession, sf_dir: str) -> tuple[moments.Stats, moments.Stats, moments.Stats]:
    """Statistics of training, validation and test rows, from one pass."""
    split = F.when(F.expr(TRAIN), "train").when(F.expr(VAL), "val").otherwise("test")
    s = moments.stats_by(vectors(spark, sf_dir).withColumn("split", split), "x", "y", ["split"])
    return s["train",], s["val",], s["test",]


def scores(spark: SparkSession, sf_dir: str, method: str, **options) -> DataFrame:
    """(method, chosen, dataset, r2): global R2 of a method's choice on each part."""
    train, val, test = parts(spark, sf_dir)
    fit = models.fit(method, train, val, **options)
    rows = [(method, float(np.real(fit.chosen)), name, models.r2(s, fit.b, fit.intercept)) for name, s in (("train", train), ("val", val), ("test", test))]
    return rounded(spark.createDataFrame(rows, "method string, chosen double, dataset string, r2 double"))


@query()
def ridge_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "ridge")


@query()
def rrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "rrr")


@query()
def pls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "pls")


@query()
def nuclear_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "nuclear_norm")


@query()
def optshrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "linear_optshrink")


@query()
def optshrink_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, "linear_optshrink", hard=True)


@query()
def multivariate_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All methods by test R2, with component R2 and rank of their maps."""
    train, val, test = parts(spark, sf_dir)
    mean, axes = models.components(train, 5)
    rows = []
    for name in models.METHODS:
        fit = models.fit(name, train, val)
        d = np.linalg.svd(fit.b, compute_uv=False)
        rows.append((name, models.r2(test, fit.b, fit.intercept), float(models.component_r2(test, fit, mean, axes).mean()), float(geometry.effective_rank(d)), geometry.participation_ratio(d)))
    out = spark.createDataFrame(rows, "method string, r2 double, pc_r2 double, effective_rank double, participation_ratio double")
    return results.ranking(rounded(out), "method", "r2")


@query()
def pca_pc_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val, test = parts(spark, sf_dir)
    fit = models.ridge(train, val)
    mean, axes = models.components(train, 10)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(models.component_r2(test, fit, mean, axes))], "component long, r2 double"))


@query()
def ridge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge R2 of predictions made row by row: the map goes into the plan as literals."""
    train, val, _ = parts(spark, sf_dir)
    done = models.predict(vectors(spark, sf_dir).where(TEST), "x", models.ridge(train, val))
    pairs = done.select(F.posexplode(F.arrays_zip("y", "prediction")).alias("j", "c")).select("j", F.col("c.y").alias("y"), F.col("c.prediction").alias("p"))
    return rounded(metrics.edge_r2(pairs))


@query()
def principal_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val, test = parts(spark, sf_dir)
    a, b = (geometry.right_subspace(models.ridge(s, val, [10.0]).b, 5) for s in (train, test))
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(geometry.principal_angles(a, b))], "idx long, degrees double"))


@query()
def rank_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, _ = parts(spark, sf_dir)
    d = np.linalg.svd(train.centered()[1], compute_uv=False)
    rows = [("effective", float(geometry.effective_rank(d))), ("entropy", geometry.entropy_rank(d)), ("participation", geometry.participation_ratio(d)), ("threshold", float(geometry.threshold_rank(d, 1.0))), ("energy_90", float(geometry.select_rank(d, "energy:0.9")))]
    return rounded(spark.createDataFrame(rows, "measure string, value double"))


@query()
def haar_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val, test = parts(spark, sf_dir)
    a, b = (geometry.gram_subspace(s, 5) for s in (train, test))
    return rounded(inference.null_summary(inference.haar_null(spark, a, 5, 500), "overlap", geometry.overlap(a, b)))


@query()
def break_pairing_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val, test = parts(spark, sf_dir)
    a, b = (geometry.right_subspace(models.ridge(s, s, [10.0]).b, 5) for s in (train, test))
    null = inference.break_pairing_null(vectors(spark, sf_dir).where(TRAIN), "id", "x", "y", b, 5, 10.0, 500)
    return rounded(inference.null_summary(null, "overlap", geometry.overlap(a, b)))


@query()
def stratified_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy rank of X'Y with pairs broken within sites only."""
    one = lambda s: [{"rank": geometry.entropy_rank(np.linalg.svd(s.centered()[1], compute_uv=False))}]
    return rounded(inference.by_broken_pairs(vectors(spark, sf_dir), "id", "x", "y", 200, one, "rank double", stratum="label"))


#: Groups of the y features in place of tiers of edges, which the tables don't have.
TIERS = {"low": list(range(11)), "middle": list(range(11, 22)), "high": list(range(22, 32)), "all": list(range(32))}


def _observed(spark: SparkSession, told: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["group"], r["k"], r["overlap"], r["r2"], r["ratio"]) for r in told], "group string, k long, overlap double, r2 double, ratio double")


@query()
def tier_break_pairing_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tier of features and k: the observed overlap against maps fitted to broken pairs, with margin and share above."""
    train, val, test = parts(spark, sf_dir)
    told = inference.group_scores(test, models.ridge(train, train, [10.0]), TIERS, [5, 10])
    null = inference.tier_null(vectors(spark, sf_dir).where(TRAIN), "id", "x", "y", test, TIERS, [5, 10], 10.0, 300)
    return rounded(inference.margins(null, _observed(spark, told).select("group", "k", F.col("overlap").alias("observed")), "group", "k"))


@query()
def hierarchy_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tier: overlap, mean feature R2 and their ratio on the test rows, with basic bootstrap intervals."""
    train, val, test = parts(spark, sf_dir)
    fitted = models.ridge(train, val)
    boot = inference.group_bootstrap(vectors(spark, sf_dir).where(TEST), "id", "x", "y", fitted, TIERS, 5, 1000)
    return rounded(inference.basic_intervals(boot, _observed(spark, inference.group_scores(test, fitted, TIERS, [5])), ["overlap", "r2", "ratio"]))


@query()
def scrambled_component_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean component R2 on test rows against that of maps fitted to scrambled x blocks, the penalty chosen again each time."""
    train, val, test = parts(spark, sf_dir)
    seen = float(models.component_r2(test, models.ridge(train, val), *models.components(train, 5)).mean())
    null = inference.scrambled_component_null(vectors(spark, sf_dir).where(TRAIN), "id", "x", "y", val, test, 5, 200)
    return rounded(inference.null_summary(null, "r2", seen))


@query()
def rank_dimension_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain in R2 of each further rank on the test rows against broken pairs, until three in a row aren't significant."""
    train, val, _ = parts(spark, sf_dir)
    return rounded(inference.rank_test(vectors(spark, sf_dir).where(TEST), "id", "x", "y", models.ridge(train, val).b, 32, 100))


def _centroids(spark: SparkSession, sf_dir: str) -> np.ndarray:
    rows = moments.long(vectors(spark, sf_dir), "y", "label").groupBy("label", "j").agg(F.avg("v").alias("v")).collect()
    out = np.zeros((10, 32))
    for r in rows:
        out[r["label"], r["j"]] = r["v"]
    return out


@query()
def rotation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val, _ = parts(spark, sf_dir)
    v, c = geometry.right_subspace(models.ridge(train, val).b, 5), _centroids(spark, sf_dir)
    rho = ((c @ v) ** 2).sum(axis=1) / (c**2).sum(axis=1)
    return rounded(inference.null_summary(inference.rotation_null(spark, v, c, 500), "mean", float(rho.mean()), corrected=False))


@query()
def mantel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _centroids(spark, sf_dir)
    gaps = lambda m: np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2))
    observed, null = inference.mantel_null(spark, gaps(c[:, :16]), gaps(c[:, 16:]), 500)
    return rounded(inference.null_summary(null, "r", observed, corrected=False))


@query()
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    boot = inference.cluster_bootstrap(table(spark, sf_dir, "events"), "user_id", "event_type", "value", 50)
    return rounded(metrics.percentile_interval(boot, "mean", "event_type"))


@query()
def bootstrap_sv(spark: SparkSession, sf_dir: str) -> DataFrame:
    boot = inference.bootstrap_singular_values(vectors(spark, sf_dir), "id", "x", "y", 5, 200)
    return rounded(boot.groupBy("idx").agg(F.avg("sigma").alias("mean"), F.stddev_samp("sigma").alias("sd"), (F.stddev_samp("sigma") / F.avg("sigma")).alias("cv")))


@query("""WITH r AS (SELECT vec_id AS id, unnest(range(32)) AS j, unnest(embedding[33:64])::DOUBLE AS y, unnest(embedding[1:32])::DOUBLE / 2 AS p FROM embeddings),
e AS (SELECT id, j % 4 AS j, sum((y - p) * (y - p)) AS err2, sum(y * y) AS t2 FROM r GROUP BY ALL),
u AS (SELECT id, rep, ('0x' || substring(md5(concat(id::VARCHAR, '|42|', rep::VARCHAR)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM (SELECT DISTINCT id FROM e) CROSS JOIN (SELECT unnest(range(30)) AS rep)),
m AS (SELECT id, rep, CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 WHEN u < 0.9999167588507119 THEN 6 WHEN u < 0.9999897508033253 THEN 7 ELSE 8 END AS times FROM u),
s AS (SELECT rep, j, 1 - sum(times * err2) / (sum(times * t2) + 1e-12::DOUBLE) AS r2 FROM e JOIN m USING (id) GROUP BY ALL) SELECT rep, round(avg(r2), 6) + 0.0 AS r2 FROM s GROUP BY rep""")
def bootstrap_pc_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = vectors(spark, sf_dir).select("id", F.posexplode(F.arrays_zip("x", "y")).alias("j", "c"))
    gap = F.col("c.y") - F.col("c.x") / 2
    errors = both.groupBy("id", (F.col("j") % 4).alias("j")).agg(F.sum(gap * gap).alias("err2"), F.sum(F.col("c.y") * F.col("c.y")).alias("t2"))
    return rounded(inference.bootstrap_component_r2(errors, "id", 30).withColumn("rep", F.col("rep").cast("long")))


@query()
def bca(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [r["v"] for r in table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v")).orderBy("c_nationkey").collect()]
    lo, hi = results.bca_interval(values)
    return rounded(spark.createDataFrame([(float(np.mean(values)), lo, hi)], "mean double, lo double, hi double"))


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, m): 7 x 7 correlation-like matrices from the first 21 numbers of each vector, made positive definite."""
    edge = F.slice(F.col("embedding").cast("array<double>"), 1, 21)
    full = V.full_matrix(edge, 7)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), spd.make_spd(full).alias("m"))


@query()
def spd_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrices(spark, sf_dir)
    base = F.lit(spd.log_euclidean_mean(rows, "m").ravel().tolist())
    each = rows.select("label", *[spd.distance(F.col("m"), base, k).alias(k) for k in (*spd.METRICS, "bures")])
    return rounded(each.groupBy("label").agg(*[F.avg(k).alias(k) for k in (*spd.METRICS, "bures")]))


@query()
def frechet_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spd.frechet_mean(matrices(spark, sf_dir), "m")
    return rounded(spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "i long, j long, v double"))


@query()
def rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on random Fourier features of the median bandwidth."""
    rows = vectors(spark, sf_dir)
    width = graphs.bandwidth(rows, "id", "x", 2000).first()["bandwidth"]
    split = F.when(F.expr(TRAIN), "train").when(F.expr(VAL), "val").otherwise("test")
    s = moments.stats_by(rows.withColumn("split", split), "x", "y", ["split"], features=models.fourier(rows, "x", 500, width))
    fit = models.ridge(s["train",], s["val",])
    return rounded(spark.createDataFrame([(n, models.r2(v, fit.b, fit.intercept)) for (n,), v in s.items()], "dataset string, r2 double"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, v): mean of each y feature by site, so 32 nodes with 10 numbers each."""
    means = moments.long(vectors(spark, sf_dir), "y", "label").groupBy("j", "label").agg(F.avg("v").alias("v"))
    return means.groupBy(F.col("j").cast("long").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "v"))), lambda c: c["v"]).alias("v"))


SQL_NODES = "long AS (SELECT label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT k - 32 AS node, label, avg(v) AS v FROM long WHERE k >= 32 GROUP BY ALL), d AS (SELECT a.node AS i, b.node AS j, sum((a.v - b.v) * (a.v - b.v)) AS d2 FROM m a JOIN m b ON a.label = b.label AND a.node < b.node GROUP BY ALL)"


@query(f"WITH {SQL_NODES} SELECT i, j, round(d2, 6) + 0.0 AS d2 FROM d")
def distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.distance_pairs(nodes(spark, sf_dir), "node", "v"))


@query(f"WITH {SQL_NODES} SELECT round(sqrt(quantile_cont(d2, 0.5) / 2), 6) + 0.0 AS bandwidth FROM d")
def median_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.bandwidth(nodes(spark, sf_dir), "node", "v"))


W = f"{SQL_NODES}, md AS (SELECT quantile_cont(d2, 0.5) AS m FROM d), w AS (SELECT i, j, exp(-d2 / greatest(m, 1e-12::DOUBLE)) AS w FROM d, md), ww AS (SELECT * FROM w UNION ALL SELECT j, i, w FROM w), t AS (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS r FROM ww) WHERE r <= 5), g AS (SELECT * FROM t UNION SELECT j, i, w FROM t)"


@query(f"WITH {W} SELECT i, j, round(w, 6) + 0.0 AS w FROM g")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.nearest(graphs.affinity(graphs.distance_pairs(nodes(spark, sf_dir), "node", "v")), 5))


@query(f"WITH {W}, dg AS (SELECT i, sum(w) AS d FROM g GROUP BY i) SELECT g.i, g.j, round(-w / sqrt(a.d * b.d), 6) + 0.0 AS v FROM g JOIN dg a ON a.i = g.i JOIN dg b ON b.i = g.j UNION ALL SELECT i, i, 1.0 FROM dg")
def graph_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.laplacian(graphs.nearest(graphs.affinity(graphs.distance_pairs(nodes(spark, sf_dir), "node", "v")), 5)))


@query()
def jled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-pass of a 32 x 32 matrix on the graph's eight smoothest eigenvectors: share of its energy that stays."""
    lap = graph_laplacian(spark, sf_dir).collect()
    m = np.zeros((32, 32))
    for r in lap:
        m[r["i"], r["j"]] = r["v"]
    u = np.linalg.eigh((m + m.T) / 2)[1][:, :8]
    s = parts(spark, sf_dir)[0].centered()[2]
    low = u @ u.T @ s @ u @ u.T
    return rounded(spark.createDataFrame([(float((low**2).sum() / (s**2).sum()), float(np.trace(low) / np.trace(s)))], "energy double, trace double"))
