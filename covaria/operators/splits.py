"""Deterministic splits, folds, samples and permutations.

Rows are put in a random order by md5 of id and seed, so the same rows fall alike whatever the partitions and engine.
Ranks within a stratum are taken in hash buckets, with the rows of earlier buckets added, so a stratum with most of the
rows is many tasks. hash_split decides row by row from the hash alone and needs no shuffle, at the price of shares that
are right on average only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covaria.sources.scratch import materialize


def draw(key: Column, seed: int) -> Column:
    """32 hex digits from key and seed, by which rows are ordered."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 12 hex digits."""
    return F.conv(F.substring(draw(key, seed), 1, 12), 16, 10).cast("double") / float(1 << 48)


def ranked(rows: DataFrame, key: str, digest: Column, *strata: str, rank: str = "_rank", size: str = "_size") -> DataFrame:
    """Add each row's rank from 1 in its stratum (of all rows, without strata) by digest and key, and the stratum's size.

    digest: hex digits; the first three name a bucket, whose rows are ranked together.
    """
    cut = rows.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 3))
    counts = cut.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(strata)], F.col("_b").alias("_kb"), before.alias("_before"), F.sum("_c").over(w).alias(size))
    here = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", key))
    same = F.col("_b") == F.col("_kb")
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = cut.withColumn("_here", here).join(known, same)
    return joined.withColumn(rank, F.col("_before") + F.col("_here")).drop("_h", "_b", "_kb", "_before", "_here", *[f"_k{i}" for i in range(len(strata))])


def stratified_split(rows: DataFrame, key: str, stratum: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, split): of each stratum, round(n * test) rows become test, then val's share of the rest, and the others train."""
    test = 1 - train - val
    if test < -1e-9 or train < 0 or val < 0:
        raise ValueError("shares must be 0 or more and add up to 1 at most")
    n, rank = F.col("_size"), F.col("_rank")
    n_test = F.round(n * test).cast("long")
    n_val = F.round((n - n_test) * (val / (train + val) if train + val else 0)).cast("long")
    split = F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train")
    return ranked(rows, key, draw(F.col(key), seed), stratum).select(key, split.alias("split"))


def hash_split(rows: DataFrame, key: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, split) from the hash alone: no shuffle, shares right on average."""
    u = uniform(F.col(key), seed)
    return rows.select(key, F.when(u < train, "train").when(u < train + val, "val").otherwise("test").alias("split"))


def split_proof(splits: DataFrame, key: str = "id") -> DataFrame:
    """One row: rows, distinct keys, keys in more than one split, and whether there are none."""
    per = splits.groupBy(key).agg(F.count_distinct("split").alias("k"), F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"), F.count_if(F.col("k") > 1).alias("n_overlap"), (F.count_if(F.col("k") > 1) == 0).alias("no_overlap"))


def folds(rows: DataFrame, key: str, k: int, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """(key, fold): ranks in hash order modulo k, within strata if given; fold sizes differ by one at most."""
    placed = ranked(rows, key, draw(F.col(key), seed), *([stratum] if stratum else []))
    return placed.select(key, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("long").alias("fold"))


def external_mapping(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """(key, mapping, role): each cohort is once the training one and once the external test."""
    a, b = first.select(key), second.select(key)
    row = lambda d, m, r: d.select(key, F.lit(m).alias("mapping"), F.lit(r).alias("role"))
    return row(a, "ds1_to_ds2", "train").union(row(b, "ds1_to_ds2", "test")).union(row(b, "ds2_to_ds1", "train")).union(row(a, "ds2_to_ds1", "test"))


def quantiles_of(rows: DataFrame, values: Mapping[str, Column], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns with linear interpolation between neighbours, nulls left out; all None where no value is left.

    All columns go through one pass. Rows of a value are counted first and values are placed in ranges, so neither repeated
    values nor all of them meet in one task; two values for each quantile reach the driver.
    """
    if not values:
        return {}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("c"), v.cast("double").alias("v")) for n, v in values.items()])).alias("x")
    counted = rows.select(each).select("x.c", "x.v").where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    placed = running_before(counted, ["c"], ["v"], "n", "below")
    total = {r["c"]: r["n"] for r in placed.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    places = {c: [p * (n - 1) for p in probs] for c, n in total.items()}
    wanted = {c: sorted({int(at) for at in ps} | {min(int(at) + 1, total[c] - 1) for at in ps}) for c, ps in places.items()}
    found: dict[str, dict[int, float]] = {c: {} for c in total}
    if wanted:
        ks = F.lit(None).cast("array<long>")
        for c, k in wanted.items():
            ks = F.when(F.col("c") == c, F.lit(k).cast("array<long>")).otherwise(ks)
        holds = F.filter(ks, lambda k: (k >= F.col("below")) & (k < F.col("below") + F.col("n")))
        for r in placed.select("c", "v", holds.alias("ks")).where(F.size("ks") > 0).collect():
            found[r["c"]].update(dict.fromkeys(r["ks"], r["v"]))
    at = lambda f, x: f[int(x)] if x == int(x) else (int(x) + 1 - x) * f[int(x)] + (x - int(x)) * f[int(x) + 1]
    return {c: [at(found[c], x) for x in places[c]] if c in total else [None] * len(probs) for c in values}


def quantiles(rows: DataFrame, value: str | Column, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles of one column, as quantiles_of."""
    return quantiles_of(rows, {"v": F.col(value) if isinstance(value, str) else value}, probs)["v"]


def quantile_edges(rows: DataFrame, value: str, parts: int) -> list[float]:
    """Distinct interpolated quantiles of a column at 0, 1/parts, ... 1."""
    return sorted({q for q in quantiles(rows, value, [i / parts for i in range(parts + 1)]) if q is not None})


def quantile_strata(rows: DataFrame, value: str, parts: int = 10, name: str = "stratum") -> DataFrame:
    """Add the place of the value among quantile edges, intervals closed on the right; equal edges count once."""
    edges = quantile_edges(rows, value, parts)
    place = F.lit(None).cast("long")
    for i in range(len(edges) - 1, 0, -1):
        place = F.when(F.col(value) <= edges[i], F.lit(i - 1).cast("long")).otherwise(place)
    return rows.withColumn(name, place)


def stratified_subsample(rows: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """Of each stratum its share of n rows, one at least and all at most, in hash order; then cut to n in hash order."""
    take = F.least(F.greatest(F.lit(1), F.round(F.col("_size") * n / rows.count()).cast("long")), F.col("_size"))
    picked = ranked(rows, key, draw(F.col(key), seed), stratum).where(F.col("_rank") <= take).drop("_rank", "_size")
    return picked.orderBy(draw(F.col(key), seed + 1), key).limit(n)


def stride(rows: DataFrame, order: Sequence[str], step: int, most: int) -> DataFrame:
    """Every step-th row in order from the first, `most` at most; the order runs over ranges, not in one task."""
    ranked = with_row_index(rows, order)
    return ranked.where((F.pmod("row_idx", F.lit(step)) == 0) & (F.floor(F.col("row_idx") / step) < most)).drop("row_idx")


def with_row_index(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add `row_idx`, the rank from 0 in the given order: rows are dealt out by ranges, and counts of the ranges before are added.

    Ranges come from samples that differ from run to run, so rows are written down with the number of their range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_p").count()
    before = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn("_r", rank).join(F.broadcast(before), "_p").withColumn("row_idx", (F.col("_before") + F.col("_r")).cast("long")).drop("_p", "_r", "_before")


def running_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """Add the sum of a column over the rows before each one of its keys, in an order that tells the rows of a key apart.

    Rows are dealt out by ranges of keys and order and written down; sums of a key's earlier ranges are added to those
    within a range, so one key, or no key at all, is many tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *keys, *order).withColumn("_p", F.spark_partition_id()), "running")
    sums = dealt.groupBy(*keys, "_p").agg(F.sum(column).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_p").alias("_kp"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_sum_before"))
    same = F.col("_p") == F.col("_kp")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = F.sum(column).over(Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    joined = dealt.withColumn("_sum_inside", F.coalesce(inside, F.lit(0))).join(before, same)
    return joined.withColumn(name, F.col("_sum_before") + F.col("_sum_inside")).drop("_p", "_kp", "_sum_before", "_sum_inside", *[f"_k{i}" for i in range(len(keys))])


def permuted(rows: DataFrame, key: str, value: str, seed: int, stratum: str | None = None) -> DataFrame:
    """(key, value) with values dealt anew among rows of a stratum (or of all rows), by joining two orders."""
    part = [stratum] if stratum else []
    place = lambda s: ranked(rows.select(key, *part, value), key, draw(F.col(key), s), *part)
    a, b = place(seed).select(key, *part, "_rank"), place(seed + 1).select(*part, value, "_rank")
    return a.join(b, [*part, "_rank"]).drop("_rank")


def halves(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """2n rows without replacement in hash order, the first n as half 0 and the others as half 1."""
    return ranked(rows.select(key), key, draw(F.col(key), seed)).where(F.col("_rank") <= 2 * n).select(key, (F.col("_rank") > n).cast("long").alias("half"))


def multiplicities(rows: DataFrame, key: str, replicates: int, seed: int = 42, *keep: str) -> DataFrame:
    """Poisson(1) bootstrap: (key, kept columns, rep, times) for times > 0.

    A draw depends on key, seed and replicate alone, so rows carry their columns along and nothing is joined or gathered;
    rows with equal keys are drawn together. The generator makes each digest once, and its first 12 hex digits are compared as
    text with those of the distribution function's values, where a number would be made anew for every comparison.
    """
    digest = lambda rep: F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}|"), rep.cast("string")))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda rep: F.struct(rep.alias("rep"), digest(rep).alias("_d")))
    cumulative, term, reached = 0.0, 0.36787944117144233, []
    for k in range(12):
        cumulative += term
        reached.append(f"{math.ceil(cumulative * (1 << 48)):012x}")
        term /= k + 1
    times = F.lit(12)
    for k in range(11, 0, -1):
        times = F.when(F.col("_d") < reached[k], k).otherwise(times)
    return rows.select(key, *keep, F.inline(drawn)).where(F.col("_d") >= reached[0]).select(key, *keep, "rep", times.cast("long").alias("times"))
