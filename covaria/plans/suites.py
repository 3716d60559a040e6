"""Queries that compose operators: preprocessing, regional features, dissociation of vectors, robustness and clinical scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covaria.functions import vectors as V
from covaria.operators import atlas, blocks, classify, geometry, metrics, models, moments, preprocess, results, splits
from covaria.plans.common import LONG, rounded, table, vectors
from covaria.plans.modelling import parts
from covaria.plans.registry import query
from covaria.plans.statistics import BASIS, _basis


def cohorts(spark: SparkSession, sf_dir: str) -> preprocess.Prepared:
    """Vectors of labels 0-7 as the first cohort, of 6-9 as the second; site and a made-up age as covariates."""
    rows = vectors(spark, sf_dir)
    cov = rows.select("id", F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("site"), (F.col("id") % 50 + 18).cast("double").alias("age"))
    part = lambda w: {"x": rows.where(w).select("id", "x"), "y": rows.where(w).select("id", "y"), "cov": cov.where("id % 11 <> 5")}
    return preprocess.prepare(part("label <= 7"), part("label >= 6"), ["age"], ["site"], "site")


@query()
def preprocessing_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of the prepared blocks by cohort and split; training rows of the first have mean 0 and deviation 1."""
    done = cohorts(spark, sf_dir).rows
    cells = done.select("dataset", "split", F.posexplode("y").alias("j", "v"))
    return rounded(cells.groupBy("dataset", "split").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")))


@query()
def verify_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.verify(cohorts(spark, sf_dir).rows)


VOXELS = "v AS (SELECT l_orderkey % 100 AS subject, l_partkey AS voxel, l_quantity AS v FROM lineitem), w AS (SELECT p_partkey AS voxel, p_size % 7 AS region, p_retailprice / 1000 AS w FROM part)"


def voxels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("subject"), F.col("l_partkey").alias("voxel"), F.col("l_quantity").alias("v"))
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("voxel"), (F.col("p_size") % 7).cast("long").alias("region"), (F.col("p_retailprice") / 1000).alias("w"))
    return v, w


@query(f"WITH {VOXELS} SELECT subject, region::BIGINT AS region, round(sum(w * v) / sum(w), 6) + 0.0 AS v FROM v JOIN w USING (voxel) WHERE w > 0.91 GROUP BY ALL")
def roi_weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, w = voxels(spark, sf_dir)
    return rounded(atlas.region_means(v, w, "subject", threshold=0.91))


@query(f"WITH {VOXELS}, g AS (SELECT voxel, avg(v) AS v FROM v GROUP BY voxel) SELECT region::BIGINT AS region, round(sum(w * v) / sum(w), 6) + 0.0 AS v FROM g JOIN w USING (voxel) WHERE w > 0.9 GROUP BY ALL")
def gradient_to_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, w = voxels(spark, sf_dir)
    return rounded(atlas.gradient_of_regions(v.groupBy("voxel").agg(F.avg("v").alias("v")), w, 0.9))


@query(f"WITH {VOXELS} SELECT region::BIGINT AS region, round(min(w), 6) + 0.0 AS least, round(quantile_cont(w, 0.5), 6) + 0.0 AS median, round(max(w), 6) + 0.0 AS most, count(*) AS n FROM w GROUP BY region")
def atlas_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(atlas.weight_audit(voxels(spark, sf_dir)[1]))


@query()
def dual_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = atlas.projector(np.array(_basis(5))[:, 1:])
    loaded = vectors(spark, sf_dir).select("label", F.posexplode(atlas.loadings(F.col("y"), p)).alias("component", "v"))
    return rounded(loaded.groupBy("label", "component").agg(F.avg("v").alias("v")))


@query(f"""WITH {LONG}, {BASIS}, p AS (SELECT id, c, sum(v * b) AS s FROM ys JOIN b ON b.i = ys.j GROUP BY ALL), q AS (SELECT p.id, b.i AS j, sum(p.s * b.b) AS u FROM p JOIN b USING (c) GROUP BY ALL)
SELECT id, round(sum(u * u), 6) + 0.0 AS coupled, round(sum((v - u) * (v - u)), 6) + 0.0 AS uncoupled, round(sum(v * v), 6) + 0.0 AS total FROM ys JOIN q USING (id, j) GROUP BY id""")
def coupled_uncoupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = vectors(spark, sf_dir).select("id", "y", V.coupled(F.col("y"), _basis()).alias("u"))
    rest = F.zip_with("y", "u", lambda a, b: a - b)
    return rounded(split.select("id", V.squares(F.col("u")).alias("coupled"), V.squares(rest).alias("uncoupled"), V.squares(F.col("y")).alias("total")))


@query(f"WITH {LONG}, {BASIS}, m AS (SELECT label, j, avg(v) AS v FROM ys GROUP BY ALL), s AS (SELECT label, c, sum(v * b) AS s FROM m JOIN b ON b.i = m.j GROUP BY ALL), e AS (SELECT label, sum(v * v) AS e FROM m GROUP BY label) SELECT label, c::BIGINT AS mode, round(s * s / e, 6) + 0.0 AS contribution FROM s JOIN e USING (label)")
def mode_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each state's centroid on each basis vector."""
    means = moments.long(vectors(spark, sf_dir), "y", "label").groupBy("label", "j").agg(F.avg("v").alias("v"))
    basis = spark.createDataFrame([(i, c, v) for i, row in enumerate(_basis()) for c, v in enumerate(row)], "j int, mode long, b double")
    scores = means.join(F.broadcast(basis), "j").groupBy("label", "mode").agg(F.sum(F.col("v") * F.col("b")).alias("s"))
    energy = means.groupBy("label").agg(F.sum(F.col("v") * F.col("v")).alias("e"))
    return rounded(scores.join(energy, "label").select("label", "mode", (F.col("s") * F.col("s") / F.col("e")).alias("contribution")))


@query(f"WITH {LONG}, m AS (SELECT label, j, avg(v) AS v FROM ys GROUP BY ALL) SELECT a.label AS state_a, b.label AS state_b, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) + 0.0 AS cosine FROM m a JOIN m b ON a.j = b.j AND a.label < b.label GROUP BY ALL")
def residual_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = moments.long(vectors(spark, sf_dir), "y", "label").groupBy("label", "j").agg(F.avg("v").alias("v"))
    a, b = means.alias("a"), means.alias("b")
    both = a.join(b, (F.col("a.j") == F.col("b.j")) & (F.col("a.label") < F.col("b.label")))
    u, v = F.col("a.v"), F.col("b.v")
    return rounded(both.groupBy(F.col("a.label").alias("state_a"), F.col("b.label").alias("state_b")).agg((F.sum(u * v) / F.sqrt(F.sum(u * u) * F.sum(v * v))).alias("cosine")))


@query("WITH s AS (SELECT user_id, event_type, avg(value) AS rho FROM events GROUP BY ALL) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY rho DESC, event_type) AS place FROM s")
def state_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("rho"))
    return per.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("rho").desc(), "event_type")).cast("long").alias("place"))


@query("SELECT c_mktsegment, c_nationkey::BIGINT AS c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def stratified_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment", F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders), q AS (SELECT quantile_cont(o_totalprice, 0.8) AS q FROM p) SELECT DISTINCT o_custkey FROM p, q WHERE o_totalprice >= q""")
def quantile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    edge = splits.quantiles(orders, "o_totalprice", [0.8])[0]
    return orders.where(F.col("o_totalprice") >= edge).select("o_custkey").distinct()


@query("""WITH g AS (SELECT c_mktsegment AS method, c_nationkey::BIGINT AS param, avg(c_acctbal) AS score FROM customer GROUP BY ALL) SELECT method, param, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, param) AS r FROM g) WHERE r = 1""")
def best_of_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("method"), F.col("c_nationkey").cast("long").alias("param")).agg(F.avg("c_acctbal").alias("score"))
    best = grid.groupBy("method").agg(F.max(F.struct("score", (-F.col("param")).alias("p"))).alias("b"))  # of equal scores the first parameter
    return rounded(best.select("method", (-F.col("b.p")).alias("param"), F.col("b.score").alias("score")))


@query("""WITH p AS (SELECT c_nationkey % 5 AS g, c_custkey AS k, c_acctbal < 1000 AS ns FROM customer), r AS (SELECT *, ns AND lag(ns, 1, false) OVER w AND lag(ns, 2, false) OVER w AS third FROM p WINDOW w AS (PARTITION BY g ORDER BY k)),
s AS (SELECT *, coalesce(sum(third::INT) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM r) SELECT g::BIGINT AS g, count(*) AS tested FROM s WHERE stopped = 0 GROUP BY g""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ordered tests run until three in a row aren't significant."""
    p = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).cast("long").alias("g"), F.col("c_custkey").alias("k"), (F.col("c_acctbal") < 1000).alias("ns"))
    return results.early_stop(p, ["g"], ["k"], "ns")


@query()
def motion_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of a map's right subspace with the full map's: in subsets by a motion covariate, and with that residualized."""
    rows = vectors(spark, sf_dir).withColumn("motion", F.abs(F.get("x", F.lit(0))))
    median = splits.quantiles(rows, "motion", [0.5])[0]
    kept = {"all": "true", "low": f"motion <= {median!r}", "very_low": f"motion <= {median / 2!r}"}
    tagged = rows.select(F.array("motion").alias("c"), "x", "y", F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in kept.items()]))).alias("condition"))
    by = {name: b for (name,), b in blocks.sums_by(tagged, ["c", "x", "y"], ["condition"]).items()}
    stats = {name: b.stats(b.weights("x"), b.weights("y")) for name, b in by.items()}
    whole = by["all"]
    on = whole.weights("1", "c")
    stats["residualized"] = whole.stats(*(whole.residual(whole.weights(n), on) for n in "xy"))
    maps = {name: geometry.right_subspace(models.ridge(s, s, [10.0]).b, 5) for name, s in stats.items()}
    return rounded(spark.createDataFrame([(k, int(stats[k].n), geometry.overlap(v, maps["all"])) for k, v in maps.items()], "condition string, n long, overlap double"))


@query()
def leakage_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test R2 of the full map less that of the map cut to three dimensions."""
    train, val, test = parts(spark, sf_dir)
    fit = models.ridge(train, val)
    full, shared = models.r2(test, fit.b, fit.intercept), models.r2(test, models.truncated(fit.b, 3), fit.intercept)
    return rounded(spark.createDataFrame([(full, shared, full - shared)], "r2_full double, r2_shared double, leakage double"))


@query()
def auc_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of text length for quality, with percentiles over 500 Poisson bootstraps of documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    scored = rows.select(F.lit("n_chars").alias("score_of"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.col("n_chars").cast("double").alias("score"), F.col("quality").cast("int").alias("y"))
    return rounded(classify.areas(scored, ["score_of"], 500))


@query()
def logistic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression of the first five sites against the rest, penalty by validation AUC; all penalties fitted together."""
    split = F.when(F.expr("id % 10 < 7"), 0).when(F.expr("id % 10 = 7"), 1).otherwise(2)
    rows = vectors(spark, sf_dir).select("id", "x", (F.col("label") < 5).cast("int").alias("case"), split.alias("part"))
    told = classify.grid(rows, "id", "x", "case", "part", {"all": (0, 32)}, replicates=0)
    return rounded(told.select("c", F.when(F.col("dataset") == 1, "val").otherwise("test").alias("dataset"), "auc", "chosen"))
