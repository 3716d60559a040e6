"""Permutation nulls and bootstraps: replicates are rows, so they run side by side as Spark tasks.

Replicates that need the data again (permutations of rows, bootstraps) are drawn inside tasks, which reduce them to p x q
sums per replicate before anything dense is done; those that don't are a range of seeds.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covaria.operators import geometry, models, moments
from covaria.operators.splits import multiplicities, ranked
from covaria.sources.scratch import materialize


def p_value(null: Column, observed: float, corrected: bool = True) -> Column:
    """Share of null values at or above the observed one; corrected: with one added to both counts."""
    above = F.count_if(null >= F.lit(float(observed)))
    return (above + 1) / (F.count(null) + 1) if corrected else above / F.count(null)


def null_summary(null: DataFrame, value: str, observed: float, corrected: bool = True) -> DataFrame:
    """One row: observed, n, mean, sd (ddof 1), 95th percentile, largest value, and p."""
    v = F.col(value)
    return null.agg(
        F.lit(float(observed)).alias("observed"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.percentile(v, 0.95).alias("p95"), F.max(v).alias("largest"),
        p_value(v, observed, corrected).alias("p"),
    )


def fan_out(spark: SparkSession, replicates: int, f: Callable[[np.random.Generator], dict[str, float]], schema: str, seed: int = 42) -> DataFrame:
    """One row per replicate: f of a generator seeded by (seed, rep). Results don't depend on partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"rep": int(r), **f(np.random.default_rng([seed, int(r)]))} for r in b["id"]])

    return spark.range(replicates).mapInPandas(run, f"rep long, {schema}")


def haar_null(spark: SparkSession, v: np.ndarray, k: int, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(rep, overlap) of a fixed subspace with random ones of k dimensions."""

    def one(rng: np.random.Generator) -> dict[str, float]:
        return {"overlap": geometry.overlap(v, np.linalg.qr(rng.standard_normal((v.shape[0], k)))[0])}

    return fan_out(spark, replicates, one, "overlap double", seed)


def rotation_null(spark: SparkSession, v: np.ndarray, centroids: np.ndarray, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(rep, state_0 ..., mean): retention of centroids (rows) in randomly rotated copies of a subspace."""
    energy = np.maximum((centroids**2).sum(axis=1), 1e-300)

    def one(rng: np.random.Generator) -> dict[str, float]:
        basis = np.linalg.qr(rng.standard_normal(v.shape))[0]
        rho = ((centroids @ basis) ** 2).sum(axis=1) / energy
        return {f"state_{i}": float(x) for i, x in enumerate(rho)} | {"mean": float(rho.mean())}

    return fan_out(spark, replicates, one, ", ".join(f"state_{i} double" for i in range(len(centroids))) + ", mean double", seed)


def mantel_null(spark: SparkSession, a: np.ndarray, b: np.ndarray, replicates: int = 1000, seed: int = 42) -> tuple[float, DataFrame]:
    """Correlation of two distance matrices' upper triangles, and (rep, r) with rows and columns of one permuted."""
    at = np.triu_indices(len(a), 1)
    corr = lambda x: float(np.corrcoef(x[at], b[at])[0, 1])

    def one(rng: np.random.Generator) -> dict[str, float]:
        p = rng.permutation(len(a))
        return {"r": corr(a[np.ix_(p, p)])}

    return corr(a), fan_out(spark, replicates, one, "r double", seed)


def broken_pairs(rows: DataFrame, key: str, x: str, y: str, replicates: int, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """(rep, x, y): for each replicate, x blocks dealt anew among rows (of a stratum), y blocks left in place.

    Two orders of the keys, which must be unique, are joined by rank within (replicate, stratum); ranks are taken in hash
    buckets. Only keys are ranked and shuffled for that; the pairs are written down and meet the blocks afterwards.
    """
    part = [stratum] if stratum else []
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")
    hash_of = lambda s: F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{s}|"), F.col("rep").cast("string")))
    place = lambda name, s: ranked(rows.select(key, *part, reps), key, hash_of(s), "rep", *part).drop("_size").withColumnRenamed(key, name)
    pairs = materialize(place("_x", seed).join(place("_y", seed + 1), ["rep", *part, "_rank"]).select("rep", "_x", "_y"), "pairs")
    left, right = (rows.select(F.col(key).alias(n), c) for n, c in (("_x", x), ("_y", y)))
    return pairs.join(left, "_x").join(right, "_y").select("rep", x, y)


def by_replicate(rows: DataFrame, x: str, y: str, f: Callable[[moments.Stats], list[dict[str, float]]], schema: str, weight: str | None = None) -> DataFrame:
    """(rep, schema): what f tells of each replicate's statistics, which are put together and solved in a task of their own.

    Tasks sum their rows first, so what meets for a replicate is half of (1 + p + q)^2 numbers of each task, and nothing but
    f's rows leaves it. No rows, no replicates.
    """
    return moments.solve_by(rows, x, y, ["rep"], lambda by: f(*by.values()), schema, weight)


def _uniform(h: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """SplitMix64 of a row's hash, a replicate and a seed, unsigned."""
    with np.errstate(over="ignore"):
        z = h.view(np.uint64) + np.uint64((rep + 1) * 0x9E3779B97F4A7C15 + (seed + 1) * 0xD1342543DE82EF95 & (2**64 - 1))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        return z ^ (z >> np.uint64(31))


#: Distribution function of Poisson(1) at 0, 1, ...
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def drawn_times(h: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """How often a replicate of a Poisson bootstrap draws rows of these hashes."""
    return np.searchsorted(POISSON, (_uniform(h, rep, seed) >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


def _in_cells(rows: DataFrame, groups: Sequence[str], block: int, seed: int) -> DataFrame:
    """Rows dealt by hash into cells of about `block` rows of a group, and sorted by group, cell and hash; written down."""
    if groups:
        sizes = rows.groupBy(*groups).count().withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)})
        same = functools.reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)])
        rows, n = rows.join(sizes, same).drop(*[f"_g{i}" for i in range(len(groups))]), F.col("count")
    else:
        n = F.lit(rows.count())
    order = [*groups, "_cell"]
    dealt = rows.withColumn("_cell", F.pmod(F.xxhash64("_h", F.lit(seed)), F.greatest(F.lit(1), F.ceil(n / block)))).drop("count")
    return materialize(dealt.repartition(*order).sortWithinPartitions(*order, "_h"), "cells")


@dataclass
class Products:
    """What a replicate has of two blocks: n, sums, sums of squares, and x'y."""

    n: float
    sx: np.ndarray
    sy: np.ndarray
    xx: np.ndarray
    yy: np.ndarray
    xy: np.ndarray

    def covariance(self, mx: np.ndarray | None = None, my: np.ndarray | None = None) -> np.ndarray:
        """x'y / n about the replicate's own means, or about those given."""
        mx, my = (self.sx / self.n if mx is None else mx), (self.sy / self.n if my is None else my)
        return (self.xy - np.outer(self.sx, my) - np.outer(mx, self.sy)) / self.n + np.outer(mx, my)

    def correlation(self) -> np.ndarray:
        """Correlations of all pairs; 0 for a constant feature."""
        vx, vy = (v / self.n - (s / self.n) ** 2 for v, s in ((self.xx, self.sx), (self.yy, self.sy)))
        size = np.sqrt(np.outer(np.maximum(vx, 0), np.maximum(vy, 0)))
        return np.where(size > 0, self.covariance() / np.where(size > 0, size, 1), 0.0)


def _draws(how: str, h: np.ndarray, rep: int, seed: int, share: float) -> Iterator[tuple[tuple, np.ndarray | slice, np.ndarray | slice, np.ndarray | None]]:
    """What a replicate takes of a cell: a further key, places of x, places of y, and weights."""
    if rep < 0:
        yield (-1,), slice(None), slice(None), None
    elif how == "bootstrap":
        yield (-1,), slice(None), slice(None), drawn_times(h, rep, seed)
    else:
        order = np.argsort(_uniform(h + np.arange(len(h)), 3 * rep, seed), kind="stable")
        if how == "break":
            yield (-1,), slice(None), order, None
        else:
            many = round(share * len(h))
            for half in (0, 1):
                at = order[half * many : (half + 1) * many]
                yield (half,), at, at if how == "halves" else at[np.argsort(_uniform(h[at] + at, 3 * rep + 1 + half, seed), kind="stable")], None


def resampled_products(
    rows: DataFrame, key: str, x: str, y: str, replicates: int, seed: int = 42, how: str = "break", stratum: str | None = None, keys: Sequence[str] = (), share: float = 0.5, observed: bool = False,
    cluster: bool = False, block: int = 4096, at_once: int = 50,
) -> DataFrame:
    """(keys, rep, half, i, row): sums of [x, 1] times [y, 1] for each replicate, and a last row with the sums of squares.

    how = "bootstrap": rows count as often as Poisson(1) draws them (cluster: all rows of a key alike). "break": y blocks are dealt anew among rows. "halves" and
    "broken_halves": two disjoint draws of `share` of the rows, numbered by `half`, with pairs kept or broken in each.
    observed: replicate -1 has the rows as they are. None of it copies rows. For pairs and halves, rows are dealt once into cells
    of about `block` rows (of a stratum), and each replicate draws within cells. Cells come from a hash of the rows, not from
    how x and y go together over rows, so these are permutations like any. Draws depend on row, seed and replicate
    alone; equal rows are drawn together. Replicates go in groups of `at_once`, each of which reads the rows again, so a task
    holds that many p x q sums. Rows with a null block don't count; a null key is a key.
    """
    if how not in ("break", "bootstrap", "halves", "broken_halves"):
        raise ValueError(f"unknown way to resample {how}")
    if not 0 < share <= 0.5:
        raise ValueError("two halves take a share of at most 0.5 each")
    groups = [*keys, *([stratum] if stratum else [])]
    blocks = [F.col(c).cast("array<double>").alias(n) for c, n in ((x, "_x"), (y, "_y"))]
    name = F.col(key).cast("string")
    h = F.xxhash64(name) if cluster and how == "bootstrap" else F.xxhash64(name, x, y)
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, h.alias("_h"), *blocks)
    celled = how != "bootstrap"
    full = _in_cells(full, groups, block, seed) if celled else materialize(full, "drawn")
    order = [*groups, "_cell"] if celled else list(keys)
    schema = T.StructType([
        *full.select(*keys).schema.fields, T.StructField("rep", T.LongType()), T.StructField("half", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType())),
    ])
    arrow = moments.to_arrow(schema)

    def of_group(reps: range) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = moments.Sums(arrow)
            shape = (0, 0)

            def cut(k: tuple, flat: np.ndarray) -> list[tuple[tuple, np.ndarray]]:
                p, q = shape
                return [*(((*k, i), r) for i, r in enumerate(flat[: p * q].reshape(p, q))), ((*k, p), flat[p * q :])]

            for batch in moments.whole_groups(batches, order, 4 * block) if celled else batches:
                if not batch.num_rows:
                    continue
                hashes, *both = batch.column("_h").to_numpy(), *(np.hstack([m, np.ones((len(m), 1))]) for m in (moments.block_of(batch, c) for c in ("_x", "_y")))
                shape = both[0].shape[1], both[1].shape[1]
                # a cell of many equal rows is drawn from in pieces, whose ends don't depend on the batches
                pieces = ((g, at[lo : lo + 4 * block]) for g, at in moments.grouped(batch, order) for lo in range(0, len(at), 4 * block)) if celled else moments.grouped(batch, order)
                for group, at in pieces:
                    h, left, right = hashes[at], *(m[at] for m in both)
                    for r in reps:
                        for half, a, b, w in _draws(how, h, r, seed, share):
                            u, v = left[a], right[b]
                            wu = u if w is None else u * w[:, None]
                            squares = [(t[:, :-1] ** 2).sum(axis=0) if w is None else w @ t[:, :-1] ** 2 for t in (u, v)]
                            sums.add((*group[: len(keys)], r, *half), np.concatenate([(wu.T @ v).ravel(), *squares]))
                if sums.full():
                    yield from sums.batches(cut)
            yield from sums.batches(cut)

        return full.mapInArrow(run, schema)

    chunks = [of_group(range(lo, min(lo + at_once, replicates))) for lo in range(-1 if observed else 0, replicates, at_once)]
    return moments.summed(functools.reduce(DataFrame.unionAll, chunks), *keys, "rep", "half", "i")


def _unpacked(part: pd.DataFrame) -> Products:
    ordered = part.sort_values("i")["row"].tolist()
    m, squares = np.array(ordered[:-1]), ordered[-1]
    p = len(m) - 1
    return Products(m[-1, -1], m[:-1, -1], m[-1, :-1], squares[:p], squares[p:], m[:-1, :-1])


def by_products(products: DataFrame, f: Callable[[dict[tuple, Products]], list[dict]], schema: str, *together: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rep, schema): what f tells of each replicate, solved in a task of its own.

    f gets the replicate's Products by the values of `together` (such as half, or a cohort); without it there is one, ().
    """

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        by = {k if isinstance(k, tuple) else (k,): _unpacked(g) for k, g in part.groupby(list(together), dropna=False)} if together else {(): _unpacked(part)}
        return pd.DataFrame([{**dict(zip(keys, key, strict=False)), "rep": int(key[-1]), **r} for r in f(by)], columns=[*keys, "rep", *names])

    names = [c.split()[0] for c in schema.split(", ")]
    types = "".join(f"`{c.name}` {c.dataType.simpleString()}, " for c in products.select(*keys).schema.fields)
    return products.groupBy(*keys, "rep").applyInPandas(solve, f"{types}rep long, {schema}")


def by_broken_pairs(rows: DataFrame, key: str, x: str, y: str, replicates: int, f: Callable[[moments.Stats], list[dict]], schema: str, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """(rep, schema): what f tells of the rows' statistics with pairs broken (within strata).

    Breaking pairs changes x'y alone, so all else is summed once, and a replicate is p x q numbers.
    """
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    base = moments.stats(full, x, y)
    return by_products(resampled_products(full, key, x, y, replicates, seed, "break", stratum), lambda by: f(replace(base, xy=by[()].xy)), schema)


def break_pairing_null(rows: DataFrame, key: str, x: str, y: str, observed: np.ndarray, k: int, alpha: float, replicates: int = 100, seed: int = 42) -> DataFrame:
    """(rep, overlap): right subspaces of ridge maps refitted at one penalty on broken pairs, against the observed one."""
    one = lambda s: [{"overlap": geometry.overlap(observed, geometry.right_subspace(models.ridge(s, s, [alpha]).b, k))}]
    return by_broken_pairs(rows, key, x, y, replicates, one, "overlap double", seed)


def group_scores(s: moments.Stats, fitted: models.Fit, groups: dict[str, list[int]], ks: Sequence[int]) -> list[dict]:
    """Per group of y features and k: overlap of truth's and prediction's leading subspaces within it, mean feature R2, and their ratio."""
    cxx, _, cyy = s.centered()
    told = fitted.b.T @ cxx @ fitted.b
    b, c = fitted.b, fitted.intercept
    sse = np.diag(s.yy) - 2 * (np.sum(b * s.xy, axis=0) + c * s.sy) + np.sum(b * (s.xx @ b), axis=0) + 2 * c * (s.sx @ b) + s.n * c * c
    sst = np.diag(cyy)
    r2 = np.where(sst > 0, 1 - sse / np.where(sst > 0, sst, 1), 0.0)
    out = []
    for name, at in groups.items():
        axes = [np.linalg.eigh(m[np.ix_(at, at)])[1][:, ::-1] for m in (cyy, told)]
        for k in ks:
            o, r = geometry.overlap(axes[0][:, :k], axes[1][:, :k]), float(r2[at].mean())
            out.append({"group": name, "k": int(min(k, len(at))), "overlap": o, "r2": r, "ratio": o / r if abs(r) > 1e-12 else float("inf")})
    return out


def tier_null(train: DataFrame, key: str, x: str, y: str, test: moments.Stats, groups: dict[str, list[int]], ks: Sequence[int], alpha: float, replicates: int = 300, seed: int = 42) -> DataFrame:
    """(rep, group, k, overlap): per group of y features, what ridge maps fitted to broken training pairs predict on the test rows."""
    one = lambda s: [{n: r[n] for n in ("group", "k", "overlap")} for r in group_scores(test, models.ridge(s, s, [alpha]), groups, ks)]
    return by_broken_pairs(train, key, x, y, replicates, one, "group string, k long, overlap double", seed)


def margins(null: DataFrame, observed: DataFrame, *by: str) -> DataFrame:
    """Per group of `by`: observed, null mean and sd (ddof 0), margin, sds above, and p with one added to both counts."""
    o = F.first("observed")
    joined = null.join(observed, list(by))
    above = F.count_if(F.col("overlap") >= F.col("observed"))
    told = joined.groupBy(*by).agg(o.alias("observed"), F.avg("overlap").alias("null_mean"), F.stddev_pop("overlap").alias("null_sd"), ((above + 1) / (F.count("*") + 1)).alias("p"))
    margin = F.col("observed") - F.col("null_mean")
    return told.withColumns({"margin": margin, "sd_above": margin / (F.col("null_sd") + 1e-12)})


def group_bootstrap(rows: DataFrame, key: str, x: str, y: str, fitted: models.Fit, groups: dict[str, list[int]], k: int, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(rep, group, k, overlap, r2, ratio) over Poisson bootstraps of the test rows, the map left as it is."""
    p = len(fitted.b)
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).alias("_u"))

    def told(by: dict[tuple, Products]) -> list[dict]:
        m = by[()]
        return group_scores(moments.Stats(m.n, m.sx[:p], m.sx[p:], m.xy[:p, :p], m.xy[:p, p:], m.xy[p:, p:]), fitted, groups, [k])

    products = resampled_products(both, key, "_u", "_u", replicates, seed, "bootstrap")
    return by_products(products, told, "group string, k long, overlap double, r2 double, ratio double")


def basic_intervals(boot: DataFrame, observed: DataFrame, values: Sequence[str], level: float = 0.95) -> DataFrame:
    """(group, value, observed, lo, hi): twice the observed value less the bootstrap's upper and lower percentiles."""
    each = lambda df, n: df.select("group", F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(v).alias(n)) for v in values])).alias("c")).select("group", "c.*")
    ends = each(boot, "x").groupBy("group", "value").agg(*[F.percentile("x", p).alias(n) for n, p in (("low", (1 - level) / 2), ("high", (1 + level) / 2))])
    return each(observed, "observed").join(ends, ["group", "value"]).select("group", "value", "observed", (2 * F.col("observed") - F.col("high")).alias("lo"), (2 * F.col("observed") - F.col("low")).alias("hi"))


def scrambled_component_null(rows: DataFrame, key: str, x: str, y: str, val: moments.Stats, test: moments.Stats, k: int, replicates: int = 100, seed: int = 42) -> DataFrame:
    """(rep, chosen, r2): mean component R2 on test rows of ridge maps fitted to scrambled x, the penalty chosen again for each."""
    def one(s: moments.Stats) -> list[dict[str, float]]:
        fitted = models.ridge(s, val)
        return [{"chosen": float(fitted.chosen), "r2": float(models.component_r2(test, fitted, *models.components(s, k)).mean())}]

    return by_broken_pairs(rows, key, x, y, replicates, one, "chosen double, r2 double", seed)


def gains(s: moments.Stats, b: np.ndarray, most: int) -> np.ndarray:
    """Gain in global R2 from each further rank of a map; rank 0 predicts 0."""
    return np.diff([models.r2(s, models.truncated(b, k)) if k else models.r2(s, np.zeros_like(b)) for k in range(most + 1)])


def rank_test(rows: DataFrame, key: str, x: str, y: str, b: np.ndarray, most: int, replicates: int = 1000, seed: int = 42, alpha: float = 0.05, stop: int = 3) -> DataFrame:
    """(rank, gain, cumulative, p, null_mean, null_sd, significant): does a further rank of a map gain more on the rows than on
    broken pairs? Ranks are told in order until `stop` in a row aren't significant.

    A replicate's gains come from its p x q sums, so ranks cost no further pass.
    """
    seen = moments.stats(rows, x, y)
    observed, start = gains(seen, b, most), models.r2(seen, np.zeros_like(b))
    one = lambda s: [{"rank": k + 1, "gain": float(g)} for k, g in enumerate(gains(s, b, most))]
    null = by_broken_pairs(rows, key, x, y, replicates, one, "rank long, gain double", seed)
    spark = rows.sparkSession
    seen = spark.createDataFrame([(k + 1, float(g), float(start + observed[: k + 1].sum())) for k, g in enumerate(observed)], "rank long, observed double, cumulative double")
    p = (F.count_if(F.col("gain") >= F.col("observed")) + 1) / (F.count("*") + 1)
    told = null.join(F.broadcast(seen), "rank").groupBy("rank").agg(
        F.first("observed").alias("gain"), F.first("cumulative").alias("cumulative"), p.alias("p"), F.avg("gain").alias("null_mean"), F.stddev_pop("gain").alias("null_sd")
    ).withColumn("significant", F.col("p") < alpha)
    # a row for each rank: as many as the map has at most
    back = Window.orderBy("rank").rowsBetween(-(stop - 1), 0)
    ended = (F.count("*").over(back) == stop) & (F.count_if("significant").over(back) == 0)
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return told.withColumn("_end", ended.cast("int")).withColumn("_past", F.coalesce(F.max("_end").over(before), F.lit(0))).where("_past = 0").drop("_end", "_past")


def bootstrap_singular_values(rows: DataFrame, key: str, x: str, y: str, k: int, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(rep, idx, sigma): leading singular values of X'Y over Poisson bootstraps of rows; each is one weighted product."""
    one = lambda by: [{"idx": i, "sigma": float(d)} for i, d in enumerate(np.linalg.svd(by[()].xy, compute_uv=False)[:k])]
    return by_products(resampled_products(rows, key, x, y, replicates, seed, "bootstrap"), one, "idx long, sigma double")


def cluster_bootstrap(windows: DataFrame, subject: str, state: str, value: str, replicates: int, seed: int = 42) -> DataFrame:
    """(rep, state, mean): state means when subjects are drawn and bring all their rows.

    Rows are summed by subject and state first, so what meets the replicates is one row for each of these.
    """
    sums = windows.groupBy(subject, state).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = multiplicities(sums, subject, replicates, seed, state, "s", "n")
    return drawn.groupBy("rep", state).agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("mean"))


def bootstrap_component_r2(errors: DataFrame, key: str, replicates: int, *methods: str, seed: int = 42) -> DataFrame:
    """(rep, methods, r2): mean over components of 1 - sum err2 / sum t2, subjects drawn alike for all methods.

    errors: a row per subject, component (j) and method with err2 and t2. Truth isn't centred again.
    """
    drawn = multiplicities(errors, key, replicates, seed, *methods, "j", "err2", "t2")
    per = drawn.groupBy("rep", *methods, "j").agg((1 - F.sum(F.col("times") * F.col("err2")) / (F.sum(F.col("times") * F.col("t2")) + 1e-12)).alias("r2"))
    return per.groupBy("rep", *methods).agg(F.avg("r2").alias("r2"))

