"""Queries on feature blocks: vectors, transforms, moments, metrics and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.functions import ids
from covaria.functions import vectors as V
from covaria.operators import geometry, metrics, moments, results, transforms
from covaria.plans.common import LONG, rounded, table, vectors
from covaria.plans.registry import query

#: Predictions for pairs (y, p): each y feature against the x feature of the same place, halved.
PAIRS = f"WITH {LONG}, pairs AS (SELECT ys.id, ys.label, ys.j, ys.v AS y, xs.v / 2 AS p FROM ys JOIN xs ON xs.id = ys.id AND xs.j = ys.j)"


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = vectors(spark, sf_dir).select("id", "label", F.posexplode(F.arrays_zip("x", "y")).alias("j", "c"))
    return both.select("id", "label", F.col("j").cast("long").alias("j"), F.col("c.y").alias("y"), (F.col("c.x") / 2).alias("p"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.long(vectors(spark, sf_dir), "y", "id", "label").withColumn("j", F.col("j").cast("long"))


@query("""SELECT vec_id AS id, e::BIGINT AS edge, round(embedding[i * 8 + j + 1]::DOUBLE, 6) + 0.0 AS v FROM embeddings CROSS JOIN (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS e FROM (SELECT unnest(range(8)) AS i) JOIN (SELECT unnest(range(8)) AS j) ON i < j)""")
def upper_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedding(spark, sf_dir).select("id", F.posexplode(V.upper_triangle(F.col("v"), 8)).alias("edge", "v"))
    return rounded(e.withColumn("edge", F.col("edge").cast("long")))


@query(f"WITH {LONG} SELECT id, k::BIGINT AS j, round(atanh(greatest(least(v * 2, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE - 1)), 6) + 0.0 AS z FROM long")
def fisher_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = F.transform("v", lambda c: c * 2)
    return rounded(embedding(spark, sf_dir).select("id", F.posexplode(V.fisher_z(twice)).alias("j", "z")).withColumn("j", F.col("j").cast("long")))


@query("""SELECT vec_id AS id, len(list_filter(embedding, lambda v: abs(v * 4) <= 1.01)) / 64 >= 0.98 AS detected, len(list_filter(embedding, lambda v: abs((v * 4)::DOUBLE) > 1 - 1e-6::DOUBLE))::BIGINT AS n_clipped FROM embeddings""")
def fisher_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.transform("v", lambda c: c * 4)
    return embedding(spark, sf_dir).select("id", four.alias("v")).select("id", V.looks_like_correlations(F.col("v")).alias("detected"), V.clipped(F.col("v")).alias("n_clipped"))


@query("SELECT vec_id AS id, round(list_sum([v::DOUBLE for v in embedding]), 6) + 0.0 AS total, round(list_sum([v::DOUBLE * v::DOUBLE for v in embedding]), 6) + 0.0 AS energy, true AS finite FROM embeddings")
def row_sum_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(embedding(spark, sf_dir).select("id", V.total(F.col("v")).alias("total"), V.squares(F.col("v")).alias("energy"), V.finite(F.col("v")).alias("finite")))


@query(f"""WITH {LONG}, p AS (SELECT id, k, abs(v) AS v FROM long), l AS (SELECT id, k, ln((v + 1e-6::DOUBLE) / sum(v + 1e-6::DOUBLE) OVER (PARTITION BY id)) AS l FROM p) SELECT id, k::BIGINT AS j, round(l - avg(l) OVER (PARTITION BY id), 6) + 0.0 AS clr FROM l""")
def clr_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = embedding(spark, sf_dir).select("id", F.transform("v", F.abs).alias("v"))
    return rounded(sizes.select("id", F.posexplode(V.clr(F.col("v"))).alias("j", "clr")).withColumn("j", F.col("j").cast("long")))


@query("""SELECT 'c_acctbal' AS name, avg((try_cast(c_acctbal AS DOUBLE) IS NOT NULL)::INT) >= 0.9 AS numeric_like FROM customer UNION ALL SELECT 'c_mktsegment', avg((try_cast(c_mktsegment AS DOUBLE) IS NOT NULL)::INT) >= 0.9 FROM customer""")
def numeric_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return spark.createDataFrame([(n, transforms.numeric_like([c], n)) for n in ("c_acctbal", "c_mktsegment")], "name string, numeric_like boolean")


def _design(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, transforms.Design]:
    c = table(spark, sf_dir, "customer").withColumn("bal", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")))
    return c, transforms.fit_design(c.where("c_custkey % 2 = 0 AND c_mktsegment <> 'MACHINERY'"), ["bal"], ["c_mktsegment"])


@query("""WITH c AS (SELECT *, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS bal FROM customer), m AS (SELECT quantile_cont(bal, 0.5) AS m FROM c WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'MACHINERY'),
l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM (SELECT DISTINCT c_mktsegment AS v FROM c WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'MACHINERY'))
SELECT c_custkey, 0::BIGINT AS j, 1.0::DOUBLE AS v FROM c UNION ALL SELECT c_custkey, 1, round(coalesce(bal, m), 6) + 0.0 FROM c, m UNION ALL SELECT c_custkey, 1 + r, (c_mktsegment = l.v)::INT::DOUBLE FROM c CROSS JOIN l WHERE r > 0""")
def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, design = _design(spark, sf_dir)
    return rounded(design.apply(c).select("c_custkey", F.posexplode("design").alias("j", "v")).withColumn("j", F.col("j").cast("long")))


@query("SELECT c_mktsegment AS level, count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1")
def unseen_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, design = _design(spark, sf_dir)
    return design.unseen(c, "c_mktsegment")


@query(f"""WITH {LONG}, s AS (SELECT j, avg(v) AS m, coalesce(nullif(stddev_pop(v), 0), 1) AS sd FROM ys WHERE id % 3 <> 0 GROUP BY j) SELECT id, j::BIGINT AS j, round((v - m) / sd, 6) + 0.0 AS v FROM ys JOIN s USING (j)""")
def zscore_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("is_train", F.col("id") % 3 != 0)
    done = transforms.scale(rows, "y", transforms.scaler(rows, "y", "is_train"))
    return rounded(done.select("id", F.posexplode("y").alias("j", "v")).withColumn("j", F.col("j").cast("long")))


@query(f"""WITH {LONG}, s AS (SELECT j, avg(v) AS m, stddev_pop(v) + 1e-8::DOUBLE AS sd FROM ys WHERE id % 3 <> 0 GROUP BY j) SELECT id, j::BIGINT AS j, round((v - m) / sd, 6) + 0.0 AS v FROM ys JOIN s USING (j)""")
def prep_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("is_train", F.col("id") % 3 != 0)
    done = transforms.scale(rows, "y", transforms.scaler(rows, "y", "is_train"), 1e-8)
    return rounded(done.select("id", F.posexplode("y").alias("j", "v")).withColumn("j", F.col("j").cast("long")))


@query(f"""WITH {LONG}, c AS (SELECT id, sum(v) AS t FROM xs GROUP BY id), r AS (SELECT ys.id, j, v, t FROM ys JOIN c USING (id)), f AS (SELECT j, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM r GROUP BY j)
SELECT id, j::BIGINT AS j, round(v - a - b * t, 6) + 0.0 AS v FROM r JOIN f USING (j)""")
def residualize_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    long = moments.long(rows.withColumn("t", V.total(F.col("x"))), "y", "id", "t").withColumn("j", F.col("j").cast("long"))
    return rounded(transforms.regress_out(long, "id", "t"))


@query(f"""WITH {LONG}, c AS (SELECT id, sum(v) AS t FROM xs GROUP BY id), r AS (SELECT ys.id, j, v, t FROM ys JOIN c USING (id)), f AS (SELECT j, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM r WHERE id % 3 <> 0 GROUP BY j)
SELECT id, j::BIGINT AS j, round(v - a - b * t, 6) + 0.0 AS v FROM r JOIN f USING (j)""")
def residualize_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("design", F.array(F.lit(1.0), V.total(F.col("x"))))
    beta = transforms.fit_ols(rows.where("id % 3 <> 0"), "design", "y")
    done = transforms.residualize(rows, "design", "y", beta)
    return rounded(done.select("id", F.posexplode("y").alias("j", "v")).withColumn("j", F.col("j").cast("long")))


@query(f"WITH {LONG} SELECT id, label, j::BIGINT AS j, round(CASE WHEN count(*) OVER w > 1 THEN v - avg(v) OVER w ELSE v END, 6) + 0.0 AS v FROM ys WINDOW w AS (PARTITION BY label, j)")
def site_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transforms.center_by(cells(spark, sf_dir), "label", "id").select("id", "label", "j", "v"))


@query(f"{PAIRS}, c AS (SELECT j, covar_pop(y, p) / (var_pop(p) + 1e-12::DOUBLE) AS s, avg(y) AS my, avg(p) AS mp FROM pairs WHERE id % 3 <> 0 GROUP BY j) SELECT j::BIGINT AS j, round(s, 6) + 0.0 AS scale, round(my - s * mp, 6) + 0.0 AS \"offset\" FROM c")
def edge_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transforms.calibration(pairs(spark, sf_dir).where("id % 3 <> 0")))


def _product(a: str, b: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"WITH {LONG} SELECT {('a.' + g) if g else ''}a.j::INT AS i, b.j::INT AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM {a} a JOIN {b} b ON a.id = b.id GROUP BY ALL"


@query(_product("xs", "xs"))
def gram_xx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.cross_product(vectors(spark, sf_dir), "x", "x"))


@query(_product("xs", "ys"))
def cross_cov_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.cross_product(vectors(spark, sf_dir), "x", "y"))


@query(_product("xs", "ys", "label"))
def cross_product_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.cross_product(vectors(spark, sf_dir), "x", "y", "label"))


@query(f"WITH {LONG} SELECT a.j::BIGINT AS i, b.j::BIGINT AS j, round(corr(a.v, b.v), 6) + 0.0 AS r FROM xs a JOIN ys b ON a.id = b.id GROUP BY ALL")
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.correlations(vectors(spark, sf_dir), "x", "y"))


@query(f"WITH {LONG}, g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM ys a JOIN ys b ON a.id = b.id GROUP BY ALL) SELECT round(pow(sum(CASE WHEN i = j THEN v ELSE 0 END), 2) / sum(v * v), 6) + 0.0 AS participation_ratio FROM g")
def participation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(moments.participation(moments.cross_product(vectors(spark, sf_dir), "y", "y")))


@query(f"WITH {LONG} SELECT label, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS sd FROM ys GROUP BY label")
def distribution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.summary(cells(spark, sf_dir), "v", "label"))


R2 = "e AS (SELECT label, j, CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) ELSE 0 END AS r2 FROM pairs GROUP BY ALL)"


@query(f"{PAIRS}, {R2} SELECT label, j::BIGINT AS j, round(r2, 6) + 0.0 AS r2 FROM e")
def edge_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.edge_r2(pairs(spark, sf_dir), "label"))


@query(f"{PAIRS}, {R2}, g AS (SELECT label, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS g FROM pairs GROUP BY label) SELECT label, round(g, 6) + 0.0 AS r2_global, round(avg(r2), 6) + 0.0 AS r2_mean, round(quantile_cont(r2, 0.5), 6) + 0.0 AS r2_median FROM e JOIN g USING (label) GROUP BY label, g")
def global_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.global_r2(pairs(spark, sf_dir), "label"))


@query(f"""{PAIRS}, e AS (SELECT j, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM pairs WHERE j < 28 GROUP BY j), n AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS e FROM (SELECT unnest(range(8)) AS i) JOIN (SELECT unnest(range(8)) AS j) ON i < j),
b AS (SELECT unnest([n.i, n.j]) AS node, r2 FROM e JOIN n ON n.e = e.j) SELECT node, round(avg(r2), 6) + 0.0 AS r2, count(*) AS n FROM b GROUP BY node""")
def node_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.node_r2(metrics.edge_r2(pairs(spark, sf_dir).where("j < 28")), ids.edges(spark, 8)))


@query(f"{PAIRS} SELECT id, round(sqrt(sum((y - p) * (y - p))), 6) + 0.0 AS burden FROM pairs GROUP BY id")
def residual_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.burden(pairs(spark, sf_dir), "id"))


@query(f"WITH {LONG}, a AS (SELECT j, var_pop(v) AS v FROM ys WHERE label < 5 GROUP BY j), b AS (SELECT j, var_pop(v) AS v FROM ys WHERE label >= 5 GROUP BY j) SELECT a.j::BIGINT AS j, round(a.v / nullif(b.v, 0), 6) + 0.0 AS ratio FROM a JOIN b USING (j)")
def variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return rounded(metrics.variance_ratio(c.where("label < 5"), c.where("label >= 5")))


CASES = "c AS (SELECT lang, quality, toxic, n_chars::DOUBLE AS v FROM documents JOIN labels USING (doc_id))"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("v"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


@query(f"""WITH {CASES}, s AS (SELECT count(v) FILTER (WHERE quality = 0) AS n0, count(v) FILTER (WHERE quality = 1) AS n1, avg(v) FILTER (WHERE quality = 0) AS m0, avg(v) FILTER (WHERE quality = 1) AS m1,
var_samp(v) FILTER (WHERE quality = 0) AS v0, var_samp(v) FILTER (WHERE quality = 1) AS v1 FROM c)
SELECT n0 AS n_controls, n1 AS n_cases, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n0 + n1 - 2)), 6) + 0.0 AS cohen_d, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) + 0.0 AS welch_t,
round(pow(v1 / n1 + v0 / n0, 2) / (v1 * v1 / (n1 * n1 * (n1 - 1)) + v0 * v0 / (n0 * n0 * (n0 - 1))), 6) + 0.0 AS welch_df FROM s""")
def cohen_d_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.effect_sizes(_cases(spark, sf_dir), "v", "quality"))


@query(f"""WITH {CASES}, r AS (SELECT quality, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS k FROM c)
SELECT round((sum(k) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)), 6) + 0.0 AS auc FROM r""")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(_cases(spark, sf_dir), "v", "quality"))


@query("""WITH l AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM l)
SELECT g AS l_returnflag, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman, round(regr_slope(y, x), 4) + 0.0 AS slope FROM r GROUP BY g""")
def pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    out = metrics.correlation(rows, "l_quantity", "l_extendedprice", "l_returnflag")
    return rounded(out.withColumn("slope", F.round("slope", 4)))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 6) + 0.0 AS theta, round(quantile_cont(l_extendedprice, 0.025), 6) + 0.0 AS lo, round(quantile_cont(l_extendedprice, 0.975), 6) + 0.0 AS hi, round(2 * avg(l_extendedprice) - quantile_cont(l_extendedprice, 0.975), 6) + 0.0 AS basic_lo, round(2 * avg(l_extendedprice) - quantile_cont(l_extendedprice, 0.025), 6) + 0.0 AS basic_hi FROM lineitem GROUP BY 1")
def percentile_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = metrics.percentile_interval(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag", level=0.95)
    lo, hi = metrics.basic_interval(F.col("theta"), F.col("lo"), F.col("hi"))
    return rounded(per.withColumns({"basic_lo": lo, "basic_hi": hi}))


@query(f"WITH {LONG}, w AS (SELECT label, j // 8 AS domain, sum(abs(v)) AS s FROM ys GROUP BY ALL) SELECT label, domain::BIGINT AS domain, round(s / sum(s) OVER (PARTITION BY label), 6) + 0.0 AS share FROM w")
def domain_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.domain_fingerprint(cells(spark, sf_dir).withColumn("domain", F.floor(F.col("j") / 8)), "domain", "label"))


@query(f"""WITH {LONG}, u AS (SELECT label AS mode, j // 8 AS gm_domain, sum(abs(v)) AS gm FROM xs GROUP BY ALL), f AS (SELECT label AS mode, j // 8 AS fnc_domain, sum(abs(v)) AS fnc FROM ys GROUP BY ALL)
SELECT mode, gm_domain::BIGINT AS gm_domain, fnc_domain::BIGINT AS fnc_domain, round((mode + 1) * gm * fnc, 6) + 0.0 AS coupling FROM u JOIN f USING (mode)""")
def mode_domain_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    side = lambda c, d, n: moments.long(rows, c, "label").groupBy(F.col("label").alias("mode"), F.floor(F.col("j") / 8).alias(d)).agg(F.sum(F.abs("v")).alias(n))
    sigma = spark.createDataFrame([(i, i + 1.0) for i in range(10)], "mode long, sigma double")
    return rounded(geometry.mode_coupling(side("x", "gm_domain", "gm"), side("y", "fnc_domain", "fnc"), sigma))


@query(f"WITH {LONG}, m AS (SELECT label, j, avg(v) AS v FROM ys GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(v) DESC, j) AS rank FROM m) SELECT label, j::BIGINT AS j, round(v, 6) + 0.0 AS v, rank FROM r WHERE rank <= 5")
def top_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = cells(spark, sf_dir).groupBy("label", "j").agg(F.avg("v").alias("v"))
    return rounded(metrics.top(means, ["label"], F.abs("v"), ["j"], 5).withColumn("rank", F.col("rank").cast("long")))


@query("""WITH e AS (SELECT i, j, avg(embedding[i * 8 + j + 1]::DOUBLE) AS v FROM embeddings CROSS JOIN (SELECT i, j FROM (SELECT unnest(range(8)) AS i) JOIN (SELECT unnest(range(8)) AS j) ON i < j) GROUP BY ALL), h AS (SELECT * FROM e ORDER BY abs(v) DESC, i, j LIMIT 10)
SELECT node, round(sum(abs(v)), 6) + 0.0 AS score FROM (SELECT unnest([i, j]) AS node, v FROM h) GROUP BY node ORDER BY sum(abs(v)) DESC, node LIMIT 3""")
def hub_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = embedding(spark, sf_dir).select(F.posexplode(V.upper_triangle(F.col("v"), 8)).alias("edge", "v")).groupBy("edge").agg(F.avg("v").alias("v"))
    edges = mean.join(F.broadcast(ids.edges(spark, 8).drop("name")), "edge").select("i", "j", "v")
    return rounded(metrics.hubs(edges, 10, 3))


@query(f"WITH {LONG}, m AS (SELECT label, j AS idx, stddev_pop(v) AS sigma FROM ys GROUP BY ALL), c AS (SELECT label, idx, sum(sigma * sigma) OVER (PARTITION BY label ORDER BY idx ROWS UNBOUNDED PRECEDING) / sum(sigma * sigma) OVER (PARTITION BY label) AS c FROM m) SELECT label, min(idx)::BIGINT AS rank FROM c WHERE c >= 0.9 GROUP BY label")
def energy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = cells(spark, sf_dir).groupBy("label", F.col("j").alias("idx")).agg(F.stddev_pop("v").alias("sigma"))
    return geometry.energy_rank(sigma, 0.9, "label")


@query(f"WITH {LONG}, m AS (SELECT label, j AS idx, stddev_pop(v) AS sigma FROM ys GROUP BY ALL), g AS (SELECT label, idx, log10(sigma) - log10(lead(sigma) OVER (PARTITION BY label ORDER BY idx)) AS gap FROM m) SELECT label, idx::BIGINT AS idx, round(gap, 6) + 0.0 AS gap FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gap DESC, idx) AS r FROM g WHERE gap IS NOT NULL) WHERE r = 1")
def max_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = cells(spark, sf_dir).groupBy("label", F.col("j").alias("idx")).agg(F.stddev_pop("v").alias("sigma"))
    return rounded(geometry.largest_gap(sigma, "label"))


def _basis(k: int = 4) -> list[list[float]]:
    """Columns of the orthonormal discrete cosine basis of 32 places."""
    import math

    return [[math.sqrt((1 if c == 0 else 2) / 32) * math.cos(math.pi * (i + 0.5) * c / 32) for c in range(k)] for i in range(32)]


BASIS = "b AS (SELECT i, c, sqrt((CASE WHEN c = 0 THEN 1 ELSE 2 END) / 32::DOUBLE) * cos(pi() * (i + 0.5) * c / 32) AS b FROM (SELECT unnest(range(32)) AS i) CROSS JOIN (SELECT unnest(range(4)) AS c))"


@query(f"WITH {LONG}, {BASIS}, p AS (SELECT id, c, sum(v * b) AS s FROM ys JOIN b ON b.i = ys.j GROUP BY ALL), e AS (SELECT id, sum(v * v) AS e FROM ys GROUP BY id) SELECT id, round(sum(s * s) / e, 6) + 0.0 AS rho FROM p JOIN e USING (id) GROUP BY id, e")
def retention_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors(spark, sf_dir).select("id", V.retention(F.col("y"), _basis()).alias("rho")))


@query(f"WITH {BASIS}, d AS (SELECT a.c AS p, o.c AS q, sum(a.b * o.b) AS v FROM b a JOIN b o ON a.i = (o.i + 8) % 32 GROUP BY ALL) SELECT round(sum(v * v) / 4, 6) + 0.0 AS overlap FROM d")
def subspace_overlap_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    v = np.array(_basis())
    return rounded(spark.createDataFrame([(geometry.overlap(v, v[(np.arange(32) - 8) % 32]),)], "overlap double"))


GRID = """r AS (SELECT c_mktsegment AS method, (c_nationkey % 5)::BIGINT AS dataset, (c_custkey % 4)::BIGINT AS seed, avg(c_acctbal) AS value FROM customer GROUP BY ALL)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("method"), (F.col("c_nationkey") % 5).cast("long").alias("dataset"), (F.col("c_custkey") % 4).alias("seed")).agg(F.avg("c_acctbal").alias("value"))


@query(f"WITH {GRID} SELECT method, dataset, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd, round(CASE count(value) WHEN 2 THEN 12.706 WHEN 3 THEN 4.303 WHEN 4 THEN 3.182 END::DOUBLE * stddev_samp(value) / sqrt(count(value)), 6) + 0.0 AS ci95 FROM r GROUP BY ALL")
def seed_summary_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.seed_summary(_grid(spark, sf_dir), "value", "method", "dataset"))


@query("SELECT lang, round(avg(n_chars), 6) + 0.0 AS n_chars_mean, round(stddev_samp(n_chars), 6) + 0.0 AS n_chars_sd FROM documents GROUP BY lang")
def group_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.group_mean_sd(table(spark, sf_dir, "documents"), ["lang"], ["n_chars"]))


@query(f"WITH {GRID}, m AS (SELECT method, round(avg(value), 6) + 0.0 AS value FROM r WHERE dataset = 1 GROUP BY 1) SELECT *, row_number() OVER (ORDER BY value DESC NULLS LAST, method) AS place FROM m")
def method_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = rounded(_grid(spark, sf_dir).where("dataset = 1").groupBy("method").agg(F.avg("value").alias("value")))
    return results.ranking(means, "method", "value").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {GRID}, w AS (SELECT method, avg(value) FILTER (WHERE dataset = 0) AS a, avg(value) FILTER (WHERE dataset = 1) AS b FROM r GROUP BY method) SELECT method, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(a - b, 6) + 0.0 AS gap, round(CASE WHEN a > 0 THEN b / a END, 6) + 0.0 AS retention FROM w")
def retention_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda d: F.avg(F.when(F.col("dataset") == d, F.col("value")))
    wide = _grid(spark, sf_dir).groupBy("method").agg(mean(0).alias("a"), mean(1).alias("b"))
    return rounded(metrics.retention_gap(wide, "a", "b"))


@query(f"WITH {GRID}, w AS (SELECT method, seed, avg(value) FILTER (WHERE dataset = 0) - avg(value) FILTER (WHERE dataset = 1) AS d FROM r GROUP BY ALL) SELECT method, count(d) AS n, round(avg(d), 6) + 0.0 AS mean_diff, round(stddev_samp(d), 6) + 0.0 AS sd_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) + 0.0 AS t FROM w GROUP BY method")
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda d: F.avg(F.when(F.col("dataset") == d, F.col("value")))
    wide = _grid(spark, sf_dir).groupBy("method", "seed").agg(mean(0).alias("a"), mean(1).alias("b"))
    return rounded(results.paired_t(wide, "a", "b", "method"))
