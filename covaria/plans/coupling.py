"""Queries on couplings in depth: classification, tangent-space regression, sweeps, dimensions, retention and residuals.

Labels below 5 stand for cases (or the first cohort), labels 8 and 9 for an external cohort, id % 40 for subjects whose vectors are
windows and the label for a window's state. Bases are a ridge map's where a query says nothing else.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.operators import analyses, blocks, classify, dimensions, dynamics, geometry, graphs, models, moments, retention, spd, splits, tangent
from covaria.plans.common import LONG, rounded, vectors
from covaria.plans.dynamics import ORDER, STATES, sequence
from covaria.plans.modelling import TEST, TIERS, TRAIN, VAL, parts
from covaria.plans.registry import query
from covaria.plans.statistics import BASIS, _basis
from covaria.sources.scratch import materialize


def _split() -> Column:
    return F.when(F.expr(TRAIN), "train").when(F.expr(VAL), "val").otherwise("test")


def _left(spark: SparkSession, sf_dir: str, k: int = 5) -> np.ndarray:
    train, val, _ = parts(spark, sf_dir)
    return analyses.left_subspace(models.ridge(train, val).b, k)


def _cases(rows: DataFrame) -> DataFrame:
    return rows.withColumn("case", (F.col("label") < 5).cast("int"))


@query()
def nested_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by outer fold for full, coupled and uncoupled blocks, penalties chosen in inner folds, with intervals."""
    return rounded(classify.nested(_cases(vectors(spark, sf_dir)), "id", "x", "case", _left(spark, sf_dir)))


@query()
def nested_classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas over folds and their paired difference to the full block's."""
    return rounded(classify.nested_summary(classify.nested(_cases(vectors(spark, sf_dir)), "id", "x", "case", _left(spark, sf_dir), replicates=0)))


@query()
def clinical_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full, coupled and uncoupled blocks: penalty by validation area, told on the test rows and on an external cohort."""
    split = F.when(F.col("label").isin(4, 9), 3).when(F.expr(TRAIN), 0).when(F.expr(VAL), 1).otherwise(2)
    rows, sets = classify.feature_sets(_cases(vectors(spark, sf_dir)).withColumn("part", split).select("id", "x", "case", "part"), "x", _left(spark, sf_dir))
    return rounded(classify.grid(rows, "id", "z", "case", "part", sets, (*classify.CS, 100.0)))


@query()
def rsfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tangent-space regression at the Frechet mean, covariates residualized there: accuracy of predicted matrices by split.

    Matrices are 8 x 8, with 28 of the 32 y features, scaled to correlations' range, as their edges.
    """
    edge = F.transform(F.slice("y", 1, 28), lambda v: F.tanh(v / 2))
    cov = F.array((F.col("id") % 50 + 18).cast("double"), (F.col("label") % 2).cast("double"))
    rows = vectors(spark, sf_dir).select("id", "x", _split().alias("split"), cov.alias("cov"), tangent.V.fisher_z(edge).alias("z"), spd.make_spd(tangent.V.full_matrix(edge, 8)).alias("m"))
    out = []
    for metric in spd.METRICS:
        fitted = tangent.fit(rows, "m", "x", "split", "cov", metric)
        told = tangent.evaluate(tangent.predict(rows, fitted, "x", "cov"), "z", "m", "predicted", "split", 8)
        out += [(metric, r["split"], r["measure"], r["value"]) for r in told] + [(metric, "val", "tangent_mse", fitted.val_mse), (metric, "train", "effective_rank", float(fitted.effective_rank()))]
    return rounded(spark.createDataFrame(out, "metric string, split string, measure string, value double"))


@query()
def residual_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy with no covariate, an age, an age and a sex, and these and x's total residualized, on test rows and an external cohort."""
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    cov = F.array((F.col("id") % 50 + 18).cast("double"), (F.col("label") % 2).cast("double"), total)
    rows = vectors(spark, sf_dir).withColumn("c", cov).withColumn("part", F.when(F.col("label") >= 8, "external").otherwise(_split()))
    by = {name: b for (name,), b in blocks.sums_by(rows, ["c", "x", "y"], ["part"]).items()}
    modes = {"none": None, "age": [0], "age_sex": [0, 1], "age_sex_total": [0, 1, 2]}
    told = [tuple(r.values()) for r in blocks.sweep(by, modes)]
    return rounded(spark.createDataFrame(told, "mode string, model_k long, alpha double, dataset string, pc_r2 double, edge_r2 double"))


@query()
def participation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participation ratio of x'y with its bootstrap interval, against broken pairs; 1,000 replicates of each."""
    return rounded(dimensions.participation_test(vectors(spark, sf_dir), "id", "x", "y", 1000))


@query()
def surrogate_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two cohorts' left subspaces against that of pairs broken in each, 100 replicates."""
    return rounded(dimensions.cohort_floor(_cases(vectors(spark, sf_dir)), "id", "x", "y", "case"))


@query()
def halves_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two disjoint draws of a quarter of the rows each, with pairs kept and broken, 80 replicates."""
    rows = vectors(spark, sf_dir)
    return rounded(dimensions.halves_floor(rows, "id", "x", "y", rows.count() // 4))


@query()
def detectability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site: leading singular values of x's correlations with y against the 95th percentile of broken pairs, 60 replicates."""
    return rounded(dimensions.detectability(vectors(spark, sf_dir), "id", "x", "y", "label"))


@query()
def dimensionality_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of x'y on nested draws of 50, 100, 200, ... rows of all sites, up to all rows; an age is residualized in each."""
    rows = vectors(spark, sf_dir).withColumn("cov", F.array((F.col("id") % 50 + 18).cast("double")))
    told = [(r["n"], r["participation_ratio"], r["entropy_rank"], r["threshold_rank"], r["sigma"][0]) for r in dimensions.ladder(rows, "id", "x", "y", 50, "label", "cov")]
    return rounded(spark.createDataFrame(told, "n long, participation_ratio double, entropy_rank double, threshold_rank long, sigma_1 double"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select((F.col("id") % 40).alias("subject"), F.col("label").cast("int").alias("state"), F.col("y").alias("w"))


def _right(spark: SparkSession, sf_dir: str) -> np.ndarray:
    train, val, _ = parts(spark, sf_dir)
    return geometry.right_subspace(models.ridge(train, val).b, 10)


@query()
def state_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention of state centroids by tier, rank and state, with intervals over 500 draws of subjects."""
    tiers = {k: v for k, v in TIERS.items() if k != "all"}
    return rounded(retention.state_retention(_windows(spark, sf_dir), "subject", "state", "w", 10, _right(spark, sf_dir), (2, 5, 10), tiers))


@query()
def local_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each state's own leading directions against the map's."""
    return rounded(retention.local_overlaps(_windows(spark, sf_dir), "state", "w", _right(spark, sf_dir), 5))


@query(f"WITH {LONG}, {BASIS}, m AS (SELECT label, j, avg(v) AS v FROM ys GROUP BY ALL), d AS (SELECT p.label AS state_a, q.label AS state_b, p.j, q.v - p.v AS v FROM m p JOIN m q ON p.j = q.j AND p.label < q.label), s AS (SELECT state_a, state_b, c, sum(v * b) AS s FROM d JOIN b ON b.i = d.j GROUP BY ALL), e AS (SELECT state_a, state_b, sum(v * v) AS e FROM d GROUP BY ALL) SELECT state_a, state_b, round(sum(s * s) / e, 6) + 0.0 AS rho FROM s JOIN e USING (state_a, state_b) GROUP BY state_a, state_b, e")
def difference_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention of what leads from one state's centroid to another's, in a fixed basis."""
    sums = retention.by_state(_windows(spark, sf_dir), "subject", "state", "w", 10)
    whole = moments.product_rows(sums.select(F.expr("array_position(onehot, 1.0D) - 1").cast("int").alias("state"), F.array(F.lit(1.0)).alias("one"), "sums"), "one", "sums", "state").collect()
    rows = np.array([r["row"] for r in sorted(whole, key=lambda r: r["state"])])  # one for each state
    told = retention.differences(rows[:, 1:] / rows[:, :1], np.array(_basis()))
    return rounded(spark.createDataFrame([tuple(r.values()) for r in told], "state_a long, state_b long, rho double"))


@query()
def accuracy_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component R2 of four methods on test rows and an external cohort, retention, and paired differences; 2,000 replicates."""
    rows = vectors(spark, sf_dir).withColumn("part", F.when(F.col("label") >= 8, "external").otherwise(_split()))
    by = moments.stats_by(rows, "x", "y", ["part"])
    fits = {name: models.fit(name, by["train",], by["val",]) for name in ("nuclear_norm", "pls", "rrr", "ridge")}
    errors = retention.component_errors(rows, "id", "x", "y", "part", fits, *models.components(by["train",], 20))
    return rounded(retention.accuracy_retention(errors, "id", "part", list(fits), [("nuclear_norm", "pls"), ("nuclear_norm", "ridge")]))


@query(f"WITH {LONG}, {BASIS}, p AS (SELECT id, c, sum(v * b) AS s FROM xs JOIN b ON b.i = xs.j GROUP BY ALL), e AS (SELECT sum(v * v) AS e FROM xs), q AS (SELECT c, sum(s * s) AS s FROM p GROUP BY c) SELECT (c + 1)::BIGINT AS r, round(sum(s) OVER (ORDER BY c) / e, 6) + 0.0 AS coupled, round(1 - sum(s) OVER (ORDER BY c) / e, 6) + 0.0 AS uncoupled FROM q, e")
def residual_rank_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of x's energy inside and outside the leading columns of a fixed basis."""
    s = moments.stats(vectors(spark, sf_dir), "x", "y")
    return rounded(spark.createDataFrame([tuple(r.values()) for r in analyses.rank_sweep(s, np.array(_basis()), (1, 2, 3, 4))], "r long, coupled double, uncoupled double"))


@query(f"WITH {LONG}, {BASIS}, p AS (SELECT id, c, sum(v * b) AS s FROM xs JOIN b ON b.i = xs.j GROUP BY ALL), q AS (SELECT p.id, b.i AS j, sum(p.s * b.b) AS u FROM p JOIN b USING (c) GROUP BY ALL), f AS (SELECT j, var_pop(u) / var_pop(v) AS f FROM xs JOIN q USING (id, j) GROUP BY j) SELECT 'd' || (j // 8) AS grp, count(*) AS n, round(avg(f), 6) + 0.0 AS mean, round(stddev_samp(f), 6) + 0.0 AS sd FROM f GROUP BY ALL")
def residual_feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of features' variance inside a fixed basis, by groups of features."""
    share = analyses.feature_shares(moments.stats(vectors(spark, sf_dir), "x", "y"), np.array(_basis()))
    told = analyses.group_shares(share, [f"d{j // 8}" for j in range(len(share))])
    return rounded(spark.createDataFrame([tuple(r.values()) for r in told], "grp string, n long, mean double, sd double"))


@query()
def nonlinear_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge and kernel ridge on what the map's left subspace leaves of x, with a row-permutation null of 200."""
    rows = vectors(spark, sf_dir)
    return rounded(analyses.nonlinear_residual(rows.where(TRAIN), rows.where(TEST), "id", "x", "y", _left(spark, sf_dir), 300))


@query()
def map_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal angles between three methods' left subspaces of five dimensions."""
    train, val, _ = parts(spark, sf_dir)
    maps = {name: models.fit(name, train, val).b for name in ("nuclear_norm", "rrr", "pls")}
    return rounded(spark.createDataFrame([tuple(r.values()) for r in analyses.stability(maps, 5)], "a string, b string, mean_angle double, max_angle double, min_angle double, mean_cos double"))


@query()
def controls_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nuclear-norm map of controls (labels 5 and above) beside everybody's: accuracy, overlaps and ranks."""
    by = moments.stats_by(vectors(spark, sf_dir).select("x", "y", _split().alias("split"), (F.col("label") >= 5).alias("control")), "x", "y", ["split", "control"])
    return rounded(spark.createDataFrame([tuple(r.values()) for r in analyses.controls_refit(by, (5, 10, 20))], "k long, measure string, value double"))


@query()
def dissociation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of predicted and true subspaces against R2 for four methods, with a null of 1,000 random subspaces."""
    train, val, test = parts(spark, sf_dir)
    fits = {name: models.fit(name, train, val) for name in ("nuclear_norm", "linear_optshrink", "rrr", "pls")}
    return rounded(analyses.dissociation(spark, test, fits, (5, 10, 20)))


@query()
def dynamic_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge maps from vectors to their users' dynamics: occupancy, dwell, energy, switching, entropy, transitions and bundles."""
    seq = sequence(spark, sf_dir).withColumn("energy", F.col("value") * F.col("value"))
    summary = dynamics.subject_summary(seq, "user_id", ORDER, "event_type", STATES, "energy", F.to_date("ts"))
    targets, groups = analyses.prediction_targets(summary, "user_id", len(STATES))
    # vectors are more than users: several of them share a user's dynamics
    users = materialize(targets, "targets")
    most = users.count()
    numbered = splits.with_row_index(users, ["user_id"]).select("y", F.col("row_idx").alias("n"))
    rows = vectors(spark, sf_dir).select("id", "x", (F.col("id") % max(1, most)).alias("n")).join(numbered, "n").select("x", "y", _split().alias("part"))
    told = analyses.prediction_suite({name: s for (name,), s in moments.stats_by(rows, "x", "y", ["part"]).items()}, groups)
    return rounded(spark.createDataFrame([tuple(r.values()) for r in told], "target string, dataset string, alpha double, r2_mean double, r2_median double, corr_mean double, corr_median double, slope double, n_targets long"))


@query()
def theory_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spiked-model overlap and R2 beside the observed ones, for a ridge map at several ranks."""
    train, val, test = parts(spark, sf_dir)
    told = [analyses.theory(train, test, models.ridge(train, val), r) for r in (5, 10, 20)]
    kinds = ", ".join(f"{k} {'long' if k in ('r', 'n_recovered') else 'double'}" for k in told[0])
    return rounded(spark.createDataFrame([tuple(r.values()) for r in told], kinds))


@query()
def mode_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the three leading modes of x'y along a gradient of x's features, with intervals over 200 bootstraps."""
    gradient = np.linspace(-1, 1, 32)
    return rounded(analyses.position_intervals(vectors(spark, sf_dir), "id", "x", "y", gradient))


@query()
def kernel_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps on 500 random Fourier features, shrunk for white noise or soft thresholded, over three bandwidths: R2 by split."""
    rows = vectors(spark, sf_dir).select("id", "x", "y", _split().alias("part"))
    width = graphs.bandwidth(rows.where("part = 'train'"), "id", "x", 2000).first()["bandwidth"]
    by = {m: moments.stats_by(rows, "x", "y", ["part"], features=models.fourier(rows, "x", 500, m * width)) for m in models.BANDWIDTHS}
    found = models.kernel_spectral({m: (s["train",], s["val",]) for m, s in by.items()})
    told = []
    for name, k in found.items():
        rank = geometry.effective_rank(np.linalg.svd(k.fit.b, compute_uv=False))
        told += [(name, k.bandwidth, k.alpha, k.shrinkage, part, models.r2(s, k.fit.b, k.fit.intercept), rank) for (part,), s in by[k.bandwidth].items()]
    return rounded(spark.createDataFrame(told, "method string, bandwidth double, alpha double, shrinkage double, dataset string, r2 double, effective_rank long"))


@query()
def estimator_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks and largest gaps of maps by nuclear norm, ridge and least squares on the same sums."""
    told = [tuple(r.values()) for r in analyses.estimator_ranks(parts(spark, sf_dir)[0], 0.3)]
    return rounded(spark.createDataFrame(told, "estimator string, effective_rank long, max_gap double, gap_after long"))
