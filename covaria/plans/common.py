"""What registered queries share: reading test tables, rounding, and fixed subsets of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, with no negative zero, so that two engines' sums agree."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with two feature blocks: id, label, x (dims 0-31) and y (dims 32-63)."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.slice(v, 1, 32).alias("x"), F.slice(v, 33, 32).alias("y"))


#: The same in SQL: long rows (id, label, j, v) of each block.
LONG = """long AS (SELECT vec_id AS id, label::BIGINT AS label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings),
xs AS (SELECT id, label, k AS j, v FROM long WHERE k < 32), ys AS (SELECT id, label, k - 32 AS j, v FROM long WHERE k >= 32)"""
