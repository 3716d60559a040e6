"""Queries on cohorts: alignment, presence, look-ups, splits and set operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.functions import ids
from covaria.operators import cohort, splits
from covaria.plans.common import rounded, table
from covaria.plans.registry import query

#: Three sets of subjects with gaps: documents, labelled ones, and those in English.
SETS = """gm AS (SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 3), fnc AS (SELECT doc_id AS id, quality FROM labels), cov AS (SELECT doc_id AS id, n_chars FROM documents WHERE lang = 'en'),
u AS (SELECT id, bool_or(m = 1) AS has_gm, bool_or(m = 2) AS has_fnc, bool_or(m = 3) AS has_cov FROM (SELECT id, 1 AS m FROM gm UNION ALL SELECT id, 2 FROM fnc UNION ALL SELECT id, 3 FROM cov) GROUP BY id)"""
NAMES = ["gm", "fnc", "cov"]
DRAW = "md5(concat({k}::VARCHAR, '|{s}'))"


def modalities(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return {
        "gm": docs.where("doc_id % 7 <> 3").select(F.col("doc_id").alias("id")),
        "fnc": labels.select(F.col("doc_id").alias("id"), "quality"),
        "cov": docs.where("lang = 'en'").select(F.col("doc_id").alias("id"), "n_chars"),
    }


@query(f"WITH {SETS} SELECT gm.id, quality, n_chars FROM gm JOIN fnc USING (id) JOIN cov USING (id)")
def modality_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.align(modalities(spark, sf_dir))


@query(f"WITH {SETS} SELECT *, has_gm AND has_fnc AND has_cov AS complete FROM u")
def presence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.presence(modalities(spark, sf_dir))


@query(f"""WITH {SETS} SELECT 'missing_gm' AS reason, count(*) FILTER (WHERE NOT has_gm) AS n FROM u UNION ALL SELECT 'missing_fnc', count(*) FILTER (WHERE NOT has_fnc) FROM u
UNION ALL SELECT 'missing_cov', count(*) FILTER (WHERE NOT has_cov) FROM u""")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.drop_reasons(cohort.presence(modalities(spark, sf_dir)), NAMES)


@query(f"""WITH {SETS} SELECT count(*) FILTER (WHERE has_gm) AS n_gm, count(*) FILTER (WHERE has_fnc) AS n_fnc, count(*) FILTER (WHERE has_cov) AS n_cov, count(*) AS n_union,
count(*) FILTER (WHERE has_gm AND has_fnc AND has_cov) AS n_complete, count(*) FILTER (WHERE NOT (has_gm AND has_fnc AND has_cov)) AS n_dropped FROM u""")
def alignment_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.alignment_proof(cohort.presence(modalities(spark, sf_dir)), NAMES)


@query("SELECT c_custkey AS id, o.n AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey")
def covariate_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("n_orders"))
    return cohort.reindex(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), orders)


@query("SELECT vec_id AS id, label::BIGINT AS label FROM embeddings WHERE label >= 5 AND vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0)")
def overlap_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    return cohort.remove_overlap(e.where("label >= 5"), e.where("id % 3 = 0"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return cohort.among(orders, table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")


@query("SELECT count(*) AS n, count(quality) AS matched, count(quality) = count(*) AS available FROM documents LEFT JOIN labels USING (doc_id)")
def motion_left_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.with_gate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "quality")


@query("SELECT doc_id AS id, coalesce(CASE WHEN quality = 1 THEN 'train' WHEN quality = 0 THEN 'test' END, 'unknown') AS split FROM documents LEFT JOIN labels USING (doc_id)")
def split_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"))
    return cohort.split_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), known)


@query("""SELECT n_nationkey::BIGINT AS node, CASE WHEN n_nationkey < 5 THEN 'SC' WHEN n_nationkey < 7 THEN 'AUD' WHEN n_nationkey < 16 THEN 'SM' WHEN n_nationkey < 20 THEN 'VS' ELSE 'Other' END AS domain FROM nation""")
def domain_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = [r if r[1] <= 16 else (16, 20, "VS") for r in ids.DOMAINS if r[0] <= 16]
    domains = spark.createDataFrame(ranges, "lo long, hi long, domain string")
    return ids.range_domain(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node")), "node", domains)


@query("""WITH d AS (SELECT * FROM (VALUES (0, 5, 'SC'), (5, 7, 'AUD'), (7, 16, 'SM'), (16, 25, 'VS'), (25, 42, 'CC'), (42, 49, 'DM'), (49, 53, 'CB')) t(lo, hi, dom)),
t AS (SELECT i, CASE WHEN dom IN ('SM', 'VS', 'AUD') THEN 0 WHEN dom IN ('CC', 'CB') THEN 1 ELSE 2 END AS tier FROM (SELECT unnest(range(53)) AS i) JOIN d ON i >= lo AND i < hi),
e AS (SELECT a.tier AS x, b.tier AS y FROM t a JOIN t b ON a.i < b.i),
g AS (SELECT unnest(CASE WHEN x = y THEN [['sensorimotor', 'heteromodal', 'transmodal'][x + 1], 'within_all']
 ELSE ['between_all', CASE least(x, y) * 3 + greatest(x, y) WHEN 1 THEN 'SM-HM' WHEN 2 THEN 'SM-TM' ELSE 'HM-TM' END] END) AS grp FROM e)
SELECT grp, count(*) AS n FROM g GROUP BY grp""")
def tier_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ids.edges(spark, 53)
    tier = lambda c: ids.tier(ids.domain_case(F.col(c), ids.DOMAINS))
    return e.select(F.explode(ids.tier_groups(tier("i"), tier("j"))).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


@query("""SELECT m.src AS map_source, k.k::BIGINT AS rank, s.seed::BIGINT AS seed FROM (VALUES ('ridge'), ('rrr')) m(src) CROSS JOIN (SELECT unnest([1, 2, 5, 10]) AS k) k CROSS JOIN (SELECT unnest(range(3)) AS seed) s""")
def grid_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = spark.createDataFrame([("ridge",), ("rrr",)], "map_source string")
    ranks, seeds = F.array(*[F.lit(k).cast("long") for k in (1, 2, 5, 10)]), F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))
    return each.withColumn("rank", F.explode(ranks)).withColumn("seed", F.explode(seeds))


@query("SELECT c_custkey, CASE WHEN starts_with(x, 'customer#') THEN substring(x, 10) ELSE x END AS sid FROM (SELECT c_custkey, lower(trim(c_name)) AS x FROM customer)")
def id_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ids.normalize_id(F.col("c_name"), lower=True, prefix="customer#").alias("sid"))


@query("SELECT lower(source) || '-' || (doc_id % 50)::VARCHAR AS nid, count(DISTINCT doc_id) AS originals FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lower("source"), F.lit("-"), (F.col("doc_id") % 50).cast("string")).alias("nid"))
    return ids.collisions(docs, "doc_id", "nid")


@query("""SELECT row_number() OVER (ORDER BY i, j) - 1 AS edge, i, j, 'IC_' || i || '--IC_' || j AS name FROM (SELECT unnest(range(53)) AS i) JOIN (SELECT unnest(range(53)) AS j) ON i < j""")
def edge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.edges(spark, 53)


@query("""SELECT 'IC_' || i || '--IC_' || j AS name, i::INT AS i, j::INT AS j FROM (SELECT unnest(range(20)) AS i) JOIN (SELECT unnest(range(20)) AS j) ON i < j UNION ALL SELECT 'ic0-ic1', NULL, NULL""")
def edge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ids.edges(spark, 20).select("name").union(spark.createDataFrame([("ic0-ic1",)], "name string"))
    return names.select("name", ids.parse_edge(F.col("name")).alias("e")).select("name", "e.i", "e.j")


@query("""WITH b AS (SELECT left(md5(c_custkey::VARCHAR), 2) AS b, count(*) AS n, sha256(string_agg(c_custkey::VARCHAR, '|' ORDER BY c_custkey::VARCHAR)) AS h FROM customer GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '|' ORDER BY b)) AS sha256 FROM b""")
def alignment_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.alignment_hash(table(spark, sf_dir, "customer"), "c_custkey")


@query("""SELECT vec_id AS id, sha256(vec_id::VARCHAR || '|' || array_to_string([round(v::DOUBLE * 1000000)::BIGINT::VARCHAR for v in embedding], ',')) AS sha256 FROM embeddings""")
def row_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return cohort.row_checksums(e, "id", ["x"])


def _ranked(rows: str, key: str, stratum: str, seed: int) -> str:
    part = f"PARTITION BY {stratum} " if stratum else ""
    return f"SELECT *, count(*) OVER ({part}) AS n, row_number() OVER ({part}ORDER BY {DRAW.format(k=key, s=seed)}, {key}) AS r FROM {rows}"


@query(f"""WITH a AS ({_ranked('customer', 'c_custkey', 'c_mktsegment', 42)}), b AS (SELECT *, round(n * (1 - 0.7::DOUBLE - 0.15::DOUBLE))::BIGINT AS t FROM a), c AS (SELECT *, round((n - t) * (0.15::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE)))::BIGINT AS v FROM b)
SELECT c_custkey, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split FROM c""")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")


@query(f"""WITH d AS (SELECT c_custkey, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM (SELECT c_custkey, ('0x' || substring({DRAW.format(k='c_custkey', s=42)}, 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM customer)) SELECT * FROM d""")
def split_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hash_split(table(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_ids, 0::BIGINT AS n_overlap, true AS no_overlap FROM customer")
def split_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_proof(split_stratified(spark, sf_dir), "c_custkey")


@query(f"WITH a AS ({_ranked('customer', 'c_custkey', '', 7)}) SELECT c_custkey, (r - 1) % 5 AS fold FROM a")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.folds(table(spark, sf_dir, "customer"), "c_custkey", 5, 7)


@query(f"WITH a AS ({_ranked('customer', 'c_custkey', 'c_mktsegment', 7)}) SELECT c_custkey, (r - 1) % 5 AS fold FROM a")
def kfold_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.folds(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 5, 7, "c_mktsegment")


@query("""WITH a AS (SELECT vec_id AS id FROM embeddings WHERE label < 7), b AS (SELECT vec_id AS id FROM embeddings WHERE label >= 7)
SELECT id, 'ds1_to_ds2' AS mapping, 'train' AS role FROM a UNION ALL SELECT id, 'ds1_to_ds2', 'test' FROM b UNION ALL SELECT id, 'ds2_to_ds1', 'train' FROM b UNION ALL SELECT id, 'ds2_to_ds1', 'test' FROM a""")
def external_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return splits.external_mapping(e.where("label < 7"), e.where("label >= 7"))


@query(f"""WITH t AS (SELECT count(*) AS total FROM customer), a AS ({_ranked('customer', 'c_custkey', 'c_mktsegment', 3)}),
p AS (SELECT c_custkey FROM a, t WHERE r <= least(greatest(1, round(n * 100 / total)::BIGINT), n)) SELECT c_custkey FROM p ORDER BY {DRAW.format(k='c_custkey', s=4)}, c_custkey LIMIT 100""")
def stratified_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_subsample(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 100, 3).select("c_custkey")


@query("""WITH q AS (SELECT unnest(quantile_cont(c_acctbal, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM customer), d AS (SELECT DISTINCT e FROM q)
SELECT c_custkey, greatest(count(*) FILTER (WHERE e < c_acctbal) - 1, 0) AS stratum FROM customer CROSS JOIN d GROUP BY c_custkey, c_acctbal""")
def quantile_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.quantile_strata(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "stratum")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 7 = 0 AND i // 7 < 500")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stride(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7, 500)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.first_rows(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").union(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT CASE WHEN a = 1 THEN 'all' WHEN is_train THEN 'train' ELSE 'rest' END AS part, n, round(m, 6) + 0.0 AS mean, round(s, 6) + 0.0 AS sd FROM (SELECT grouping(is_train) AS a, is_train, count(*) AS n, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM (SELECT c_acctbal, c_custkey % 3 = 0 AS is_train FROM customer) GROUP BY GROUPING SETS ((), (is_train)))")
def grouping_sets_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cohort.distribution(table(spark, sf_dir, "customer").select("c_acctbal", (F.col("c_custkey") % 3 == 0).alias("is_train")), "c_acctbal", "is_train"))


@query(f"""WITH a AS (SELECT c_custkey, c_mktsegment AS g, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {DRAW.format(k='c_custkey', s=11)}, c_custkey) AS r FROM customer),
b AS (SELECT c_mktsegment AS g, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {DRAW.format(k='c_custkey', s=12)}, c_custkey) AS r FROM customer) SELECT c_custkey, g AS c_mktsegment, c_acctbal FROM a JOIN b USING (g, r)""")
def permute_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.permuted(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", 11, "c_mktsegment").select("c_custkey", "c_mktsegment", "c_acctbal")


@query(f"WITH a AS ({_ranked('customer', 'c_custkey', '', 5)}) SELECT c_custkey, (CASE WHEN r > 50 THEN 1 ELSE 0 END)::BIGINT AS half FROM a WHERE r <= 100")
def disjoint_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.halves(table(spark, sf_dir, "customer"), "c_custkey", 50, 5)


#: Poisson(1) count of a uniform u: one for each value of its distribution function that u has reached.
POISSON = " + ".join(f"(u >= {sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)):.17g}::DOUBLE)::BIGINT" for k in range(12))


@query(f"""WITH u AS (SELECT c_custkey, rep, ('0x' || substring(md5(concat(c_custkey::VARCHAR, '|42|', rep::VARCHAR)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM customer CROSS JOIN (SELECT unnest(range(20)) AS rep)),
t AS (SELECT rep, {POISSON} AS times, c_acctbal FROM u JOIN customer USING (c_custkey))
SELECT rep, round(sum(times * c_acctbal) / sum(times), 6) + 0.0 AS mean FROM t GROUP BY rep""")
def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = splits.multiplicities(table(spark, sf_dir, "customer"), "c_custkey", 20, 42, "c_acctbal")
    return rounded(times.groupBy(F.col("rep").cast("long").alias("rep")).agg((F.sum(F.col("times") * F.col("c_acctbal")) / F.sum("times")).alias("mean")))
