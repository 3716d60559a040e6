"""Affinity graphs of nodes: distances, bandwidth, nearest neighbours and the normalized Laplacian.

Nodes are components or regions (some dozens), or a sample of rows of bounded size; pairs are the self-join of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covaria.functions import vectors as V
from covaria.operators.splits import draw


def distance_pairs(nodes: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, j, d2) for nodes i < j."""
    a = nodes.select(F.col(key).alias("i"), F.col(vector).alias("_a"))
    b = nodes.select(F.col(key).alias("j"), F.col(vector).alias("_b"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", V.squares(F.zip_with("_a", "_b", lambda x, y: x - y)).alias("d2"))


def bandwidth(rows: DataFrame, key: str, vector: str, sample: int = 2000, seed: int = 0) -> DataFrame:
    """One row: root of half the median squared distance, over a sample of at most `sample` rows."""
    picked = rows.select(key, vector).orderBy(draw(F.col(key), seed), key).limit(sample)
    return distance_pairs(picked, key, vector).agg(F.sqrt(F.percentile("d2", 0.5) / 2).alias("bandwidth"))


def affinity(pairs: DataFrame) -> DataFrame:
    """(i, j, w) both ways: Gaussian of the squared distance by its median."""
    median = pairs.agg(F.percentile("d2", 0.5).alias("_m"))
    w = pairs.crossJoin(F.broadcast(median)).select("i", "j", F.exp(-F.col("d2") / F.greatest("_m", F.lit(1e-12))).alias("w"))  # one row
    return w.union(w.select(F.col("j"), F.col("i"), "w"))


def nearest(graph: DataFrame, k: int) -> DataFrame:
    """Edges among the k heaviest of either end, both ways."""
    top = graph.withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy(F.col("w").desc(), "j"))).where(F.col("_r") <= k).drop("_r")
    return top.union(top.select(F.col("j"), F.col("i"), "w")).distinct()


def laplacian(graph: DataFrame) -> DataFrame:
    """(i, j, v) of I - D^-1/2 W D^-1/2; nodes without edges aren't in it."""
    degree = graph.groupBy("i").agg(F.sum("w").alias("d"))
    scaled = graph.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("e")), "j").select("i", "j", (-F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("v"))
    return scaled.union(degree.select("i", F.col("i").alias("j"), F.lit(1.0)))
