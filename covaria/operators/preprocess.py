"""The preprocessing suite: two cohorts aligned, split, residualized and scaled with what the first one's training rows tell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions import vectors as V
from covaria.operators import cohort, splits, transforms


@dataclass
class Prepared:
    """Rows of both cohorts (id, dataset, split, x, y), the learnt design, and the number of rows that overlap removed."""

    rows: DataFrame
    design: transforms.Design
    removed: int


def prepare(
    first: Mapping[str, DataFrame], second: Mapping[str, DataFrame], numeric: Sequence[str], categorical: Sequence[str], stratum: str, train: float = 0.7, val: float = 0.15, seed: int = 42
) -> Prepared:
    """Each cohort: tables x (id, x), y (id, y) and cov (id and covariates).

    Subjects are those of all three tables; the second cohort loses those of the first. The sum of a subject's x is a
    covariate of its own (`total`). Splits are stratified by a covariate; the design, the residuals' coefficients and
    the scalers come from the first cohort's training rows and are applied to all rows of both.
    """
    one, two = (cohort.align(c) for c in (first, second))
    before = two.count()
    two = cohort.remove_overlap(two, one)
    split = splits.stratified_split(one, "id", stratum, train, val, seed)
    both = one.join(split, "id").withColumn("dataset", F.lit("ds1")).unionByName(two.withColumn("split", F.lit("external")).withColumn("dataset", F.lit("ds2")))
    both = both.withColumn("total", V.total(F.col("x")))
    learn = both.where("dataset = 'ds1' AND split = 'train'")
    design = transforms.fit_design(learn, [*numeric, "total"], categorical)
    rows, learn = design.apply(both), design.apply(learn)
    for block in ("x", "y"):
        rows = transforms.residualize(rows, "design", block, transforms.fit_ols(learn, "design", block))
    rows = rows.withColumn("is_train", (F.col("dataset") == "ds1") & (F.col("split") == "train"))
    for block in ("x", "y"):
        rows = transforms.scale(rows, block, transforms.scaler(rows, block, "is_train"))
    return Prepared(rows.select("id", "dataset", "split", "x", "y"), design, before - two.count())


def verify(rows: DataFrame, blocks: Sequence[str] = ("x", "y")) -> DataFrame:
    """One row of counts and checks: unique ids, disjoint cohorts, finite values, one length for each block, and whether all hold."""
    per = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("dataset").alias("k"))
    ids = per.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col("k") > 1).alias("n_shared"))
    checks = rows.agg(*[F.count_if(~V.finite(F.col(b))).alias(f"n_not_finite_{b}") for b in blocks], *[(F.max(F.size(b)) - F.min(F.size(b))).alias(f"spread_{b}") for b in blocks])
    passed = (F.col("n_repeated") == 0) & (F.col("n_shared") == 0)
    for b in blocks:
        passed = passed & (F.col(f"n_not_finite_{b}") == 0) & (F.col(f"spread_{b}") == 0)
    return ids.crossJoin(checks).withColumn("passed", passed)  # one row each
