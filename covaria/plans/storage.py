"""Queries through the readers and writers: tables go to the shared folder in a format and are read back from it."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.functions import vectors as V
from covaria.operators import cohort, geometry, models, moments, results, spd, splits
from covaria.plans.common import LONG, rounded, table, vectors
from covaria.plans.registry import query
from covaria.sources import readers, writers
from covaria.sources.scratch import shared_dir


def _path(spark: SparkSession, ending: str) -> str:
    return f"{shared_dir(spark)}/covaria-io-{uuid.uuid4().hex}.{ending}"


@query("SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 6) + 0.0 AS c_acctbal FROM customer")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as tab-separated text and read with its schema."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    path = _path(spark, "tsv")
    writers.write_tsv(rows, path)
    return rounded(readers.read_table(spark, path, rows.schema))


@query("SELECT 's' || vec_id AS id, j, round(embedding[j + 1]::DOUBLE, 6) + 0.0 AS v FROM embeddings, (SELECT unnest(range(3)) AS j) WHERE vec_id % 7 <> 3")
def csv_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide comma-separated text whose schema is inferred: the key by candidates, numeric columns as vectors, rows with a gap left out."""
    e = table(spark, sf_dir, "embeddings")
    gap = lambda j: F.when((F.col("vec_id") % 7 != 3) | (F.lit(j) != 1), F.get("embedding", F.lit(j)).cast("double")).alias(f"f{j}")
    path = _path(spark, "csv")
    e.select(F.concat(F.lit(" s"), F.col("vec_id").cast("string")).alias("SubjectID"), F.lit("x").alias("site"), *[gap(j) for j in range(3)]).write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    wide = readers.read_table(spark, path)
    key = readers.infer_column(wide.columns, None, ["subject_id", "SubjectID"])
    found = readers.feature_vectors(wide, key)
    return rounded(found.select("id", F.posexplode("x").alias("j", "v")).withColumn("j", F.col("j").cast("long")))


@query("SELECT vec_id::VARCHAR AS id, p AS j, round(atanh(greatest(-0.999999::DOUBLE, least(0.999999::DOUBLE, embedding[k + 1]::DOUBLE))), 6) + 0.0 AS v FROM embeddings, (SELECT unnest([0, 1, 2]::BIGINT[]) AS p, unnest([1, 2, 5]::BIGINT[]) AS k)")
def csv_edge_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 x 3 matrices in text: their upper triangles, as Fisher z where values look like correlations."""
    e = table(spark, sf_dir, "embeddings")
    path = _path(spark, "csv")
    e.select("vec_id", *[F.get("embedding", F.lit(j)).cast("double").alias(f"m{j}") for j in range(9)]).write.csv(path, header=True)
    edges = readers.edge_vectors(readers.read_table(spark, path), "vec_id", 3)
    done = readers.fisher_z_vectors(edges, force=True)
    return rounded(done.select("id", F.posexplode("y").alias("j", "v")).withColumn("j", F.col("j").cast("long")))


@query("SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 5 <> 1")
def stream_finite_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of wide text, finite numbers only."""
    o = table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 5
    price = F.when(kind == 0, "n/a").when(kind == 1, "NaN").otherwise(F.col("o_totalprice").cast("string"))
    path = _path(spark, "csv")
    o.select("o_orderkey", *[F.lit(k).alias(f"w{k}") for k in range(20)], price.alias("price")).write.csv(path, header=True)
    return readers.stream_finite(spark, path, "o_orderkey", "price").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "price")


@query(f"WITH {LONG}, a AS (SELECT id, j, v FROM xs), m AS (SELECT j, avg(v) AS m FROM a GROUP BY j) SELECT id, j, round(v - m, 6) + 0.0 AS v FROM a JOIN m USING (j)")
def block_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and centred blocks in one partitioned store; the centred variant is read, and the raw one's files aren't."""
    rows = vectors(spark, sf_dir).select("id", "x")
    mean = {r["j"]: r["mean"] for r in moments.column_stats(rows, "x").collect()}
    centred = rows.select("id", F.zip_with("x", F.lit([mean[j] for j in sorted(mean)]), lambda a, b: a - b).alias("x"))
    kinds = [d.select(F.lit("first").alias("dataset"), F.lit(v).alias("variant"), F.lit("x").alias("block"), "id", F.col("x").alias("values")) for v, d in (("raw", rows), ("centred", centred))]
    path = _path(spark, "parquet")
    writers.write_blocks(kinds[0].unionByName(kinds[1]), path)
    found = readers.variant(spark.read.parquet(path).where("dataset = 'first' AND block = 'x'"), "centred")
    return rounded(found.select("id", F.posexplode("values").alias("j", "v")).withColumn("j", F.col("j").cast("long")))


@query("""WITH d AS (SELECT c_custkey AS id, (row_number() OVER (ORDER BY md5(concat(c_custkey::VARCHAR, '|42')), c_custkey) - 1) % 5 AS fold FROM customer) SELECT f.fold::BIGINT AS fold, CASE WHEN d.fold = f.fold THEN 'test' WHEN d.fold = (f.fold + 1) % 5 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(id)::BIGINT AS ids FROM d, (SELECT unnest(range(5)) AS fold) f GROUP BY ALL""")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation splits, a folder for each fold, read back and counted."""
    placed = splits.folds(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", 5)
    each = placed.select("id", F.col("fold").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    split = F.when(F.col("own") == F.col("fold"), "test").when(F.col("own") == (F.col("fold") + 1) % 5, "val").otherwise("train")
    path = _path(spark, "parquet")
    writers.write_splits(each.select("id", "fold", split.alias("split")), path)
    return spark.read.parquet(path).groupBy(F.col("fold").cast("long").alias("fold"), "split").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that two runs append to; of each customer the last row stays."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    path = _path(spark, "parquet")
    for part in (o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")):
        writers.append_rows(part, path)
    return writers.latest(spark.read.parquet(path), ["o_custkey"], "o_orderkey")


@query("""WITH s AS (SELECT c_mktsegment, count(*)::DOUBLE AS n, avg(c_acctbal) AS mean, max(c_acctbal) AS most FROM customer GROUP BY ALL) SELECT c_mktsegment, metric, round(value, 4) + 0.0 AS value FROM (UNPIVOT s ON n, mean, most INTO NAME metric VALUE value)""")
def json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table as JSON, read back and turned into one row for each metric."""
    told = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("n"), F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("most"))
    path = _path(spark, "json")
    writers.write_json(told, path)
    return rounded(writers.tidy(readers.read_table(spark, path, told.schema), ["c_mktsegment"], ["n", "mean", "most"]), 4)


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer WHERE c_custkey % 11 <> 4), w AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0), j AS (SELECT id, bal FROM w LEFT JOIN c USING (id)) SELECT id, round(coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM j)), 6) + 0.0 AS bal FROM j""")
def covariate_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariates of the wanted ids, with the median of what is known where nothing is."""
    c = table(spark, sf_dir, "customer")
    known = c.where("c_custkey % 11 <> 4").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal").cast("string")).alias("bal"))
    return rounded(readers.load_covariates(known, c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")), ["bal"]))


@query("SELECT name, n, size FROM (SELECT 'x1' AS name, count(*) FILTER (WHERE label < 7) AS n, 32::BIGINT AS size FROM embeddings UNION ALL SELECT 'y1', count(*) FILTER (WHERE label < 7), 32 FROM embeddings UNION ALL SELECT 'x2', count(*) FILTER (WHERE label >= 7), 32 FROM embeddings UNION ALL SELECT 'y2', count(*) FILTER (WHERE label >= 7), 32 FROM embeddings)")
def contract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both cohorts' blocks after all checks of the contract: rows and length of each."""
    rows = vectors(spark, sf_dir)
    tables = {f"{b}{k}": rows.where(w).select("id", b) for k, w in ((1, "label < 7"), (2, "label >= 7")) for b in "xy"}
    known = readers.load_contracts(tables, splits.hash_split(tables["x1"], "id"))
    told = [known[n].select(F.lit(n).alias("name"), F.size(known[n].columns[1]).alias("s")) for n in tables]
    whole = told[0].union(told[1]).union(told[2]).union(told[3])
    return whole.groupBy("name").agg(F.count("*").alias("n"), F.max("s").cast("long").alias("size"))


@query("SELECT c_custkey, 'sub/' || c_custkey || '/map.bin' AS path FROM customer")
def subject_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.with_paths(table(spark, sf_dir, "customer").select("c_custkey"), "sub/{id}/map.bin", "c_custkey")


@query("SELECT m.c_mktsegment AS method, s.seed FROM (SELECT DISTINCT c_mktsegment FROM customer) m, (SELECT unnest(range(5))::BIGINT AS seed) s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = m.c_mktsegment AND c.c_nationkey = s.seed)")
def missing_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods and seeds that a store of coefficients doesn't have yet."""
    c = table(spark, sf_dir, "customer")
    wanted = c.select(F.col("c_mktsegment").alias("method")).distinct().select("method", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("seed"))
    return writers.missing_fits(wanted, c.select(F.col("c_mktsegment").alias("method"), F.col("c_nationkey").cast("long").alias("seed")))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 4 NOT IN (1, 2)")
def finite_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without nulls, NaN and infinities."""
    bad = F.when(F.col("id") % 4 == 1, float("nan")).when(F.col("id") % 4 == 2, F.lit(None)).otherwise(0.5)
    return vectors(spark, sf_dir).where(V.finite(F.concat("x", F.array(bad)))).select("id")


@query("SELECT c_custkey, c_acctbal FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of wanted keys, after a check that fails on one that isn't there."""
    known = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    cohort.assert_all_found(wanted, known, "c_custkey")
    return known.join(wanted, "c_custkey", "left_semi")


_TWO = "SELECT vec_id AS id, embedding[1]::DOUBLE + 0.2 AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE + 0.2 AS c FROM embeddings"


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda j: F.get("embedding", F.lit(j)).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(at(0) + 0.2, at(1), at(1), at(2) + 0.2).alias("m"))


@query(f"WITH m AS ({_TWO}) SELECT id, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) >= -1e-8 AS ok FROM m")
def spd_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether 2 x 2 matrices have no eigenvalue below 0."""
    return _two(spark, sf_dir).select("id", spd.is_spd(F.col("m")).alias("ok"))


@query(f"""WITH m AS ({_TWO}), e AS (SELECT *, (a + c) / 2 AS h, sqrt((a - c) * (a - c) / 4 + b * b) AS r FROM m), f AS (SELECT *, greatest(h + r, 1e-6::DOUBLE) AS p, greatest(h - r, 1e-6::DOUBLE) AS q FROM e),
l AS (SELECT *, CASE WHEN r > 0 THEN (p - q) / (2 * r) ELSE 0 END AS k, (p + q) / 2 AS t FROM f) SELECT id, round(t + k * (a - h), 6) + 0.0 AS m11, round(k * b, 6) + 0.0 AS m12, round(t + k * (c - h), 6) + 0.0 AS m22 FROM l""")
def spd_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 matrices with eigenvalues raised to the floor, as a function of the matrix itself."""
    fixed = _two(spark, sf_dir).select("id", spd.make_spd(F.col("m")).alias("m"))
    return rounded(fixed.select("id", *[F.get("m", F.lit(k)).alias(n) for k, n in ((0, "m11"), (1, "m12"), (3, "m22"))]))


@query("""WITH r AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[33]::DOUBLE AS y FROM embeddings WHERE vec_id % 10 < 7), s AS (SELECT regr_sxx(a, b) AS bb, regr_syy(a, b) AS aa, regr_sxy(a, b) AS ab, regr_sxy(a, y) AS ay, regr_sxy(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM r),
t AS (SELECT *, ((bb + 10) * ay - ab * yb) / ((aa + 10) * (bb + 10) - ab * ab) AS ca, ((aa + 10) * yb - ab * ay) / ((aa + 10) * (bb + 10) - ab * ab) AS cb FROM s) SELECT round(ca, 8) + 0.0 AS b1, round(cb, 8) + 0.0 AS b2, round(my - ca * ma - cb * mb, 8) + 0.0 AS intercept FROM t""")
def ridge_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge of one target on two features at one penalty."""
    rows = vectors(spark, sf_dir).where("id % 10 < 7").select(F.slice("x", 1, 2).alias("x"), F.slice("y", 1, 1).alias("y"))
    s = moments.stats(rows, "x", "y")
    fit = models.ridge(s, s, [10.0])
    return rounded(spark.createDataFrame([(float(fit.b[0, 0]), float(fit.b[1, 0]), float(fit.intercept[0]))], "b1 double, b2 double, intercept double"), 8)


@query()
def multi_seed_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test R2 of four methods over five seeds of the split, with mean, deviation and interval; one pass for all seeds."""
    rows = vectors(spark, sf_dir)
    u = lambda s: splits.uniform(F.col("id"), s)
    parts = [F.when(u(s) < 0.7, "train").when(u(s) < 0.85, "val").otherwise("test") for s in range(42, 47)]
    each = rows.select("x", "y", F.posexplode(F.array(*parts)).alias("seed", "split"))
    by = moments.stats_by(each, "x", "y", ["seed", "split"])
    told = []
    for seed in range(5):
        train, val, test = (by[seed, s] for s in ("train", "val", "test"))
        for name in ("ridge", "rrr", "pls", "nuclear_norm"):
            fit = models.fit(name, train, val)
            told.append((name, seed, models.r2(test, fit.b, fit.intercept)))
    return rounded(results.seed_summary(spark.createDataFrame(told, "method string, seed int, value double"), "value", "method"))


@query()
def mode_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left modes of three methods paired with the ridge map's by the size of their correlation, with its sign."""
    s = moments.stats_by(vectors(spark, sf_dir).withColumn("part", F.when(F.col("id") % 10 < 7, "train").otherwise("val")), "x", "y", ["part"])
    left = {name: np.linalg.svd(models.fit(name, s["train",], s["val",]).b, full_matrices=False)[0][:, :5] for name in ("ridge", "rrr", "pls")}
    told = [(name, *pair) for name, u in left.items() if name != "ridge" for pair in geometry.align_modes(left["ridge"], u)]
    return rounded(spark.createDataFrame(told, "method string, mode long, other long, r double"))
