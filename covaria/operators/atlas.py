"""Regional features from voxels: weighted means by region, loadings on component maps, gradients of regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def region_means(voxels: DataFrame, weights: DataFrame, *keys: str, threshold: float = 0.0) -> DataFrame:
    """(keys, region, v): voxel values weighted by each region's map, weights above a threshold only.

    voxels: keys, voxel, v; weights: voxel, region, w. Regions whose weights add up to nothing give no row, nor do values
    that are null or NaN. Voxels and weights meet by voxel and are summed by (keys, region) before anything is gathered.
    """
    kept = weights.where((F.col("w") > threshold) & ~F.isnan("w"))
    joined = voxels.where(F.col("v").isNotNull() & ~F.isnan("v")).join(kept, "voxel")
    total = F.sum("w")
    return joined.groupBy(*keys, "region").agg(F.when(total > 0, F.sum(F.col("w") * F.col("v")) / total).alias("v")).where("v IS NOT NULL")


def gradient_of_regions(gradient: DataFrame, weights: DataFrame, least: float = 0.1) -> DataFrame:
    """(region, v): mean gradient weighted by probabilities above `least`."""
    return region_means(gradient, weights, threshold=least)


def projector(maps: np.ndarray, rcond: float = 1e-8) -> np.ndarray:
    """Pseudo-inverse (components x voxels) of component maps (voxels x components), each centred and of length 1."""
    m = maps - maps.mean(axis=0)
    return np.linalg.pinv(m / np.maximum(np.linalg.norm(m, axis=0), 1e-300), rcond=rcond)


def loadings(volume: Column, p: np.ndarray) -> Column:
    """Component loadings of an array of voxel values, centred; p is fixed and small, and goes into the plan."""
    mean = F.aggregate(volume, F.lit(0.0), lambda s, v: s + v) / F.size(volume)
    dots = [F.aggregate(F.zip_with(volume, F.lit(row.tolist()), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v) for row in p]
    return F.array(*[d - mean * float(row.sum()) for d, row in zip(dots, p, strict=True)])


def weight_audit(weights: DataFrame) -> DataFrame:
    """(region, least, median, most, n) of each map's weights."""
    return weights.groupBy("region").agg(F.min("w").alias("least"), F.percentile("w", 0.5).alias("median"), F.max("w").alias("most"), F.count("*").alias("n"))
