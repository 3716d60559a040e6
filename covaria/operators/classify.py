"""Logistic regression of many models at once, nested cross-validation, and areas under ROC curves with intervals.

A row says of which folds it is in an array column, and a model names the values there that it learns from. One Newton step of
all models is one pass: tasks sum each model's loss, gradient and Hessian over their rows, and the driver solves systems of
features by features. So folds, penalties and feature sets cost no pass of their own, and rows aren't copied.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covaria.operators import moments
from covaria.operators.inference import drawn_times
from covaria.operators.splits import draw, ranked
from covaria.sources.scratch import materialize

# Default penalties.
CS = (0.01, 0.1, 1.0, 10.0)
#: The Newton decrement, as a share of the loss, at which a model is done; and the most steps it may take.
TOL, STEPS = 1e-12, 100


@dataclass(frozen=True)
class Model:
    """Features start to stop of a block, learnt from rows whose member[place] is in train, with penalty |w|^2 / 2c."""

    name: str
    start: int
    stop: int
    place: int
    train: tuple[int, ...]
    c: float


class _Step:
    """Newton's method for one model: a candidate is taken if it lowers the loss enough, else half way is tried."""

    def __init__(self, model: Model) -> None:
        self.model, d = model, model.stop - model.start + 1
        self.w, self.penalty = np.zeros(d), np.full(d, 1 / model.c)
        self.penalty[0] = 0  # the intercept is free
        self.base, self.direction, self.loss, self.slope, self.size = self.w, np.zeros(d), np.inf, 0.0, 1.0
        self.done, self.one_class, self.tried = False, False, 0

    def hear(self, sums: np.ndarray) -> None:
        d = len(self.w)
        n, cases, loss = sums[:3]
        if n == 0 or cases in (0, n):
            self.done = self.one_class = True
            return
        self.tried += 1
        if self.tried > STEPS:
            raise ValueError(f"no convergence of {self.model} in {STEPS} steps")
        loss += self.penalty @ self.w**2 / 2
        if loss > self.loss + 1e-4 * self.size * self.slope + 1e-12 * abs(loss):
            self.size /= 2
            self.w = self.base + self.size * self.direction
            return
        upper = np.zeros((d, d))
        upper[np.triu_indices(d)] = sums[3 + d :]
        hessian = upper + np.triu(upper, 1).T + np.diag(self.penalty)
        gradient = sums[3 : 3 + d] + self.penalty * self.w
        self.direction = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        self.base, self.loss, self.slope, self.size = self.w, loss, gradient @ self.direction, 1.0
        self.w = self.base + self.direction
        self.done = -self.slope <= TOL * max(1.0, loss)


def _members(batch: pa.RecordBatch, member: str) -> np.ndarray:
    column = batch.column(member)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame, x: str, y: str, member: str, models: Sequence[Model]) -> list[np.ndarray | None]:
    """Coefficients of each model, its intercept first; None where its rows are none or of one class.

    Minimized is the sum of log losses plus |w|^2 / 2c, the intercept free. y is 0 or 1; rows with a null block, label or member
    don't count. Each step reads the rows once, so write them down before. What comes back of a step is half of features^2
    numbers a model.
    """
    full = rows.select(x, F.col(y).cast("double").alias("_y"), member).where(F.col(x).isNotNull() & F.col("_y").isNotNull() & F.col(member).isNotNull())
    schema = T.StructType([T.StructField("m", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType()))])
    arrow = moments.to_arrow(schema)
    steps = [_Step(m) for m in models]
    spark = rows.sparkSession
    while True:
        asked = [(i, s.model, s.w) for i, s in enumerate(steps) if not s.done]
        if not asked:
            return [None if s.one_class else s.w for s in steps]
        sent = spark.sparkContext.broadcast(asked)  # features by models, whatever the rows

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = moments.Sums(arrow)
            sets: dict[tuple[int, int], list] = {}
            for i, m, w in sent.value:
                sets.setdefault((m.start, m.stop), []).append((i, m, w))
            for batch in batches:
                if not batch.num_rows:
                    continue
                block, labels, places = moments.block_of(batch, x), batch.column("_y").to_numpy(), _members(batch, member)
                masks = {(m.place, m.train): np.isin(places[:, m.place], m.train) for _, m, _ in sent.value}
                for (start, stop), mine in sets.items():
                    design = np.hstack([np.ones((len(block), 1)), block[:, start:stop]])
                    at = np.triu_indices(design.shape[1])
                    for i, m, w in mine:
                        rows_ = masks[m.place, m.train]
                        d, t = design[rows_], labels[rows_]
                        z = d @ w
                        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                        loss = np.sum(np.logaddexp(0, z) - t * z)
                        hessian = (d * (p * (1 - p))[:, None]).T @ d
                        sums.add((i,), np.concatenate(([len(t), t.sum(), loss], d.T @ (p - t), hessian[at])))
            yield from sums.batches()

        told = {r["m"]: np.array(r["row"]) for r in moments.summed(full.mapInArrow(run, schema), "m").collect()}
        for i, m, _ in asked:
            d = m.stop - m.start + 1
            steps[i].hear(told.get(i, np.zeros(3 + d + d * (d + 1) // 2)))
        sent.unpersist()


def scores(rows: DataFrame, key: str, x: str, y: str, member: str, models: Sequence[Model], fits: Sequence[np.ndarray | None], on: Sequence[tuple[int, ...]]) -> DataFrame:
    """(m, h, score, y): the linear score of each model m on the rows whose member at the model's place is in on[m].

    h is a hash of the key. Models without coefficients give no rows.
    """
    full = rows.select(F.xxhash64(F.col(key).cast("string")).alias("_h"), x, F.col(y).cast("int").alias("_y"), member)
    full = full.where(F.col(x).isNotNull() & F.col("_y").isNotNull() & F.col(member).isNotNull())
    sent = rows.sparkSession.sparkContext.broadcast([(i, m, w, o) for i, (m, w, o) in enumerate(zip(models, fits, on, strict=True)) if w is not None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, places, labels, hashes = moments.block_of(batch, x), _members(batch, member), batch.column("_y").to_numpy(), batch.column("_h").to_numpy()
            for i, m, w, o in sent.value:
                at = np.flatnonzero(np.isin(places[:, m.place], o))
                score = block[at, m.start : m.stop] @ w[1:] + w[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, dtype=np.int32)), pa.array(hashes[at]), pa.array(score), pa.array(labels[at])], names=["m", "h", "score", "y"])

    return full.mapInArrow(run, "m int, h long, score double, y int")


class _Area:
    """Wins, cases and others of a stretch of rows in ascending order of scores, for the rows as they are and for each replicate."""

    def __init__(self, many: int) -> None:
        self.wins, self.cases, self.others = np.zeros(many), np.zeros(many), np.zeros(many)
        self.low, self.tie = None, None

    def add(self, score: np.ndarray, case: np.ndarray, other: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate(([True], score[1:] != score[:-1])))
        p, q = np.add.reduceat(case, first, axis=0), np.add.reduceat(other, first, axis=0)
        score = score[first]
        if self.tie and self.tie[0] == score[0]:  # a tie that goes on from the batch before
            p[0] += self.tie[1]
            q[0] += self.tie[2]
        elif self.tie:
            self.close()
        self.low = score[0] if self.low is None else self.low
        self.tie = score[-1], p[-1], q[-1]
        below = self.others + np.cumsum(q[:-1], axis=0) - q[:-1]
        self.wins += (p[:-1] * (below + q[:-1] / 2)).sum(axis=0)
        self.cases += p[:-1].sum(axis=0)
        self.others += q[:-1].sum(axis=0)

    def close(self) -> None:
        _, p, q = self.tie
        self.wins += p * (self.others + q / 2)
        self.cases += p
        self.others += q
        self.tie = None


def areas(scored: DataFrame, keys: Sequence[str], replicates: int = 500, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(keys, n, n_pos, auc, lo, hi): area under the ROC curve of scores (ties count half) with its bootstrap percentiles.

    scored: keys, h (a hash of the row's key), score, y (0 or 1). Rows are sorted once, in ranges of score; a range passes on its
    wins, cases and others for every replicate of a Poisson bootstrap at once, and later ranges win against all before, so
    rows aren't copied. Rows of one score are in one range, which is read as a stream. Without rows of both classes the area
    is null; lo and hi are null without replicates. Null scores don't count.
    """
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.where("score IS NOT NULL AND y IS NOT NULL").select(*keys, "h", "score", "y").repartitionByRange(parts, *keys, "score").sortWithinPartitions(*keys, "score")
    many = 1 + replicates
    schema = T.StructType([*dealt.select(*keys).schema.fields, T.StructField("low", T.DoubleType()), T.StructField("row", T.ArrayType(T.DoubleType()))])
    arrow = moments.to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, _Area] = {}
        sums = moments.Sums(arrow)

        def end(key: tuple) -> None:
            area = found.pop(key)
            area.close()
            sums.add((*key, float(area.low)), np.concatenate([area.wins, area.cases, area.others]))

        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                h = batch.column("h").to_numpy()
                weight = np.column_stack([np.ones(len(h)), *(drawn_times(h, r, seed) for r in range(replicates))])
                label, score = batch.column("y").to_numpy(), batch.column("score").to_numpy()
                for key, at in moments.grouped(batch, keys):
                    for other in [k for k in found if k != key]:
                        end(other)  # rows are sorted, so the group before is over
                    case = label[at] == 1
                    found.setdefault(key, _Area(many)).add(score[at], weight[at] * case[:, None], weight[at] * ~case[:, None])
            yield from sums.batches()
        for key in list(found):
            end(key)
        yield from sums.batches()

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        wins, cases, others = np.array(part.sort_values("low")["row"].tolist()).reshape(len(part), 3, many).transpose(1, 0, 2)
        below = np.cumsum(others, axis=0) - others
        with np.errstate(divide="ignore", invalid="ignore"):
            auc = (wins + cases * below).sum(axis=0) / (cases.sum(axis=0) * others.sum(axis=0))
        known = auc[1:][np.isfinite(auc[1:])]
        ends = np.percentile(known, [50 * (1 - level), 50 * (1 + level)]) if len(known) else (None, None)
        told = {"n": int(cases[:, 0].sum() + others[:, 0].sum()), "n_pos": int(cases[:, 0].sum()), "auc": auc[0] if np.isfinite(auc[0]) else None, "lo": ends[0], "hi": ends[1]}
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | told]).astype({"auc": float, "lo": float, "hi": float})

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in dealt.select(*keys).schema.fields)
    return dealt.mapInArrow(run, schema).groupBy(*keys).applyInPandas(solve, f"{kinds}n long, n_pos long, auc double, lo double, hi double")


def _areas_of(rows: DataFrame, key: str, x: str, y: str, member: str, models: Sequence[Model], fits: Sequence, on: Sequence[tuple[int, ...]], replicates: int, seed: int) -> dict[int, dict]:
    return {r["m"]: r.asDict() for r in areas(scores(rows, key, x, y, member, models, fits, on), ["m"], replicates, seed).collect()}


def nested_members(rows: DataFrame, key: str, y: str, outer: int, inner: int, seed: int) -> DataFrame:
    """Add fold (0 to outer - 1) and member, in which place k is the row's inner fold among the rows outside fold k, or -1 in it.

    Rows of a class are ranked by a hash of key and seed; folds take them in turn, and so do the inner folds of each training
    set, so sizes differ by one at most within a class.
    """
    at = F.col("_rank") - 1
    placed = ranked(rows, key, draw(F.col(key), seed), y)
    inside = [F.when(F.pmod(at, F.lit(outer)) == k, -1).otherwise(F.pmod(at - F.floor((at + (outer - 1 - k)) / outer), F.lit(inner))).cast("int") for k in range(outer)]
    return placed.withColumn("fold", F.pmod(at, F.lit(outer)).cast("int")).withColumn("member", F.array(*inside)).drop("_rank", "_size")


def feature_sets(rows: DataFrame, x: str, basis: np.ndarray, name: str = "z") -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """Rows with their block in coordinates along an orthonormal basis (p x r) and then across it, and where each set lies.

    Sets are full, coupled (in the basis' span) and uncoupled. A penalty on |w| is the same in any orthonormal coordinates, so
    models on these give the scores of models on projected blocks, from one block.
    """
    p, r = basis.shape
    across = np.linalg.svd(basis, full_matrices=True)[0][:, r:]
    return moments.linear_map(rows, x, np.hstack([basis, across]), name=name), {"full": (0, p), "coupled": (0, r), "uncoupled": (r, p)}


def nested(rows: DataFrame, key: str, x: str, y: str, basis: np.ndarray, cs: Sequence[float] = CS, outer: int = 5, inner: int = 3, seed: int = 42, replicates: int = 500) -> DataFrame:
    """(condition, fold, c, inner_auc, n, n_pos, auc, lo, hi): nested cross-validation of full, coupled and uncoupled blocks.

    In each outer fold a penalty is chosen by the mean area over inner folds (the first best; folds of one class don't
    count), the model is refitted on all training rows, and its area on the fold is told with a bootstrap interval. Rows with
    a null label don't count; keys are unique. A fold without both classes has null areas.
    """
    known = nested_members(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, F.col(y).cast("int").alias("_label")), key, "_label", outer, inner, seed)
    mapped, sets = feature_sets(known, x, basis)
    data = materialize(mapped.select(key, "z", "_label", "member"), "nested")
    trials = [(Model(name, a, b, k, tuple(i for i in range(inner) if i != out), c), out) for name, (a, b) in sets.items() for k in range(outer) for c in cs for out in range(inner)]
    models = [m for m, _ in trials]
    told = _areas_of(data, key, "z", "_label", "member", models, fit(data, "z", "_label", "member", models), [(out,) for _, out in trials], 0, seed)
    by: dict[tuple[str, int, float], list[float]] = {}
    for i, m in enumerate(models):
        by.setdefault((m.name, m.place, m.c), []).append((told.get(i) or {}).get("auc"))
    mean = {k: float(np.mean([v for v in vs if v is not None])) if any(v is not None for v in vs) else 0.0 for k, vs in by.items()}
    chosen = {(name, k): max(cs, key=lambda c: mean[name, k, c]) for name in sets for k in range(outer)}  # noqa: B023  used at once; max takes the first of equals
    models = [Model(name, *sets[name], k, tuple(range(inner)), c) for (name, k), c in chosen.items()]
    told = _areas_of(data, key, "z", "_label", "member", models, fit(data, "z", "_label", "member", models), [(-1,)] * len(models), replicates, seed)
    empty = {"n": 0, "n_pos": 0, "auc": None, "lo": None, "hi": None}
    out = [(m.name, m.place, m.c, mean[m.name, m.place, m.c], *((told.get(i) or empty)[c] for c in empty)) for i, m in enumerate(models)]
    return rows.sparkSession.createDataFrame(out, "condition string, fold long, c double, inner_auc double, n long, n_pos long, auc double, lo double, hi double")


def nested_summary(folds: DataFrame) -> DataFrame:
    """(condition, mean_auc, sd_auc, min_auc, max_auc, diff_to_full): over folds; sd has ddof 0, the difference is paired by fold."""
    full = folds.where("condition = 'full'").select("fold", F.col("auc").alias("_full"))
    a = F.col("auc")
    return folds.join(full, "fold", "left").groupBy("condition").agg(
        F.avg(a).alias("mean_auc"), F.stddev_pop(a).alias("sd_auc"), F.min(a).alias("min_auc"), F.max(a).alias("max_auc"), F.avg(a - F.col("_full")).alias("diff_to_full")
    )


def grid(rows: DataFrame, key: str, x: str, y: str, split: str, sets: dict[str, tuple[int, int]], cs: Sequence[float] = CS, seed: int = 42, replicates: int = 500) -> DataFrame:
    """(feature_set, c, dataset, n, n_pos, auc, lo, hi, chosen): models of every set and penalty fitted to split 0.

    The penalty with the best area on split 1 is chosen (the first best); areas are told of splits 1, 2, ... (validation, test,
    external cohorts), all from the same fits.
    """
    data = materialize(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(split).isNotNull()).select(key, x, F.col(y).cast("int").alias("_label"), F.array(F.col(split).cast("int")).alias("member")), "grid")
    models = [Model(name, a, b, 0, (0,), c) for name, (a, b) in sets.items() for c in cs]
    fits = fit(data, x, "_label", "member", models)
    others = [r["s"] for r in data.select(F.get("member", F.lit(0)).alias("s")).where("s > 0").distinct().orderBy("s").collect()]
    each = [(i, s) for i in range(len(models)) for s in others]
    found = _areas_of(data, key, x, "_label", "member", [models[i] for i, _ in each], [fits[i] for i, _ in each], [(s,) for _, s in each], replicates, seed)
    told = {(models[i].name, models[i].c, s): found.get(n) for n, (i, s) in enumerate(each)}
    best = {name: max(cs, key=lambda c: (told.get((name, c, 1)) or {}).get("auc") or 0.0) for name in sets}  # noqa: B023
    rows_ = [(name, float(c), int(s), r["n"], r["n_pos"], r["auc"], r["lo"], r["hi"], c == best[name]) for (name, c, s), r in told.items() if r]
    return rows.sparkSession.createDataFrame(rows_, "feature_set string, c double, dataset long, n long, n_pos long, auc double, lo double, hi double, chosen boolean")
