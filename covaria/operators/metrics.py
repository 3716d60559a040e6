"""Accuracy, effect sizes and other statistics of long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covaria.operators.splits import running_before


def summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """min, max, mean and sd (ddof 0) without nulls and NaN; 0 where nothing is left."""
    v = F.nanvl(F.col(value), F.lit(None))
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    return rows.groupBy(*keys).agg(zero(F.min(v), "min"), zero(F.max(v), "max"), zero(F.avg(v), "mean"), zero(F.stddev_pop(v), "sd"))


def edge_r2(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, j, r2) from rows (j, y, p): 1 - residual by total sum of squares about the feature's own mean; 0 where that isn't finite."""
    sst = F.var_pop("y") * F.count("*")
    sse = F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))
    return pairs.groupBy(*keys, "j").agg(F.when(sst > 0, 1 - sse / sst).otherwise(0.0).alias("r2"))


def global_r2(pairs: DataFrame, *keys: str) -> DataFrame:
    """R2 of all cells about their one grand mean, with the mean and median of edge_r2."""
    flat = pairs.groupBy(*keys).agg((1 - F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))) / (F.var_pop("y") * F.count("*"))).alias("r2_global"))
    per = edge_r2(pairs, *keys).groupBy(*keys).agg(F.avg("r2").alias("r2_mean"), F.percentile("r2", 0.5).alias("r2_median"))
    return flat.join(per, list(keys)) if keys else flat.crossJoin(F.broadcast(per))  # one row each


def node_r2(per_edge: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean r2 of a node's edges; each edge (j = edge) counts for both of its ends."""
    ends = per_edge.join(F.broadcast(edges.select(F.col("edge").alias("j"), "i", F.col("j").alias("k"))), "j")
    return ends.select(F.explode(F.array("i", "k")).alias("node"), "r2").groupBy("node").agg(F.avg("r2").alias("r2"), F.count("*").alias("n"))


def burden(pairs: DataFrame, key: str) -> DataFrame:
    """Length of each subject's residual vector, from rows (key, y, p)."""
    return pairs.groupBy(key).agg(F.sqrt(F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))).alias("burden"))


def variance_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """(j, ratio): variance (ddof 0) of each feature in a by that in b, null where b's is 0."""
    va, vb = (d.groupBy("j").agg(F.var_pop("v").alias(n)) for d, n in ((a, "_a"), (b, "_b")))
    return va.join(vb, "j").select("j", (F.col("_a") / F.nullif("_b", F.lit(0.0))).alias("ratio"))


def effect_sizes(rows: DataFrame, value: str, case: str, *keys: str) -> DataFrame:
    """Cohen's d (pooled, ddof 1; 0 where the pooled sd is below 1e-12) and Welch's t and its degrees of freedom, cases less controls.

    Null with fewer than two rows on a side.
    """
    one = lambda flag: F.when(F.col(case) == flag, F.col(value))
    per = rows.groupBy(*keys).agg(*[f(one(flag)).alias(f"_{n}{flag}") for flag in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n0, n1, v0, v1 = F.col("_n0"), F.col("_n1"), F.col("_v0"), F.col("_v1")
    gap = F.col("_m1") - F.col("_m0")
    pooled = F.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n0 + n1 - 2))
    se2 = v1 / n1 + v0 / n0
    enough = (n0 >= 2) & (n1 >= 2)
    return per.select(
        *keys, n0.alias("n_controls"), n1.alias("n_cases"), F.when(enough, F.when(pooled < 1e-12, 0.0).otherwise(gap / pooled)).alias("cohen_d"),
        F.when(enough & (se2 > 0), gap / F.sqrt(se2)).alias("welch_t"),
        F.when(enough & (se2 > 0), se2 * se2 / (v1 * v1 / (n1 * n1 * (n1 - 1)) + v0 * v0 / (n0 * n0 * (n0 - 1)))).alias("welch_df"),
    )


def mid_ranks(rows: DataFrame, value: str, *keys: str, name: str = "rank") -> DataFrame:
    """Add average ranks from 1. Distinct values are counted before they are ordered, so ties cost one row."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = running_before(counted, keys, [value], "_n", "_before")
    ranks = placed.select(*keys, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranks, [*keys, value])


def auc(rows: DataFrame, score: str, case: str, *keys: str) -> DataFrame:
    """Area under the ROC curve by mid-ranks; null unless both classes occur."""
    counted = rows.groupBy(*keys, score).agg(F.count_if(F.col(case) == 1).alias("_pos"), F.count_if(F.col(case) == 0).alias("_q"))
    placed = running_before(counted, keys, [score], "_q", "_below")
    wins = placed.withColumn("_w", F.col("_pos") * (F.col("_below") + F.col("_q") / 2))
    return wins.groupBy(*keys).agg((F.sum("_w") / F.nullif(F.sum("_pos") * F.sum("_q"), F.lit(0))).alias("auc"))


def correlation(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Pearson and Spearman correlations and the slope of y on x."""
    ranked = mid_ranks(mid_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, *keys, name="_rx"), y, *keys, name="_ry")
    return ranked.groupBy(*keys).agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.regr_slope(y, x).alias("slope"))


def percentile_interval(rows: DataFrame, value: str, *keys: str, level: float = 0.95) -> DataFrame:
    """Percentile interval by linear interpolation, and the basic one about `theta`, the mean."""
    a = (1 - level) / 2
    q = F.percentile(value, F.lit([a, 1 - a]))
    return rows.groupBy(*keys).agg(F.avg(value).alias("theta"), F.get(q, F.lit(0)).alias("lo"), F.get(q, F.lit(1)).alias("hi"))


def basic_interval(theta: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    return 2 * theta - hi, 2 * theta - lo


def retention_gap(rows: DataFrame, first: str, second: str) -> DataFrame:
    """gap = first - second, and retention = second / first where first is positive (null otherwise)."""
    a, b = F.col(first), F.col(second)
    return rows.withColumn("gap", a - b).withColumn("retention", F.when(a > 0, b / a))


def domain_fingerprint(weights: DataFrame, domain: str, *keys: str) -> DataFrame:
    """Share of each domain in the sum of sizes of weights: (keys, domain, share)."""
    per = weights.groupBy(*keys, domain).agg(F.sum(F.abs("v")).alias("s"))
    return per.select(*keys, domain, (F.col("s") / F.nullif(F.sum("s").over(Window.partitionBy(*keys)), F.lit(0.0))).alias("share"))


def top(rows: DataFrame, keys: Sequence[str], by: Column, tie: Sequence[str], n: int) -> DataFrame:
    """The n rows of each group with the greatest `by`, ties by the columns given, with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(by.desc(), *tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hubs(edges: DataFrame, n_edges: int, n_nodes: int) -> DataFrame:
    """Nodes by the summed size of weights of the heaviest edges (i, j, v) that they end: the first n_nodes."""
    heavy = edges.orderBy(F.abs("v").desc(), "i", "j").limit(n_edges)
    score = heavy.select(F.explode(F.array("i", "j")).alias("node"), F.abs("v").alias("w")).groupBy("node").agg(F.sum("w").alias("score"))
    return score.orderBy(F.col("score").desc(), "node").limit(n_nodes)
