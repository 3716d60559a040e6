"""Moments and cross-products of feature blocks.

A block is an array column, one row per subject. Products over subjects are the only step that touches all rows: each
task multiplies its batches as matrices and passes on one partial, a row for each feature, of which products of a block
with itself hold the upper triangle only. Partials are added by feature, so what is shuffled depends on tasks and
features and not on subjects. Everything dense is done on the sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of sums that a task holds before it passes them on.
HELD = 256 << 20
#: Bytes of a block that a task maps or multiplies at once, and rows of which it learns how wide a block is.
AT_ONCE, FIRST = 4 << 20, 64


def long(rows: DataFrame, vector: str, *keep: str) -> DataFrame:
    """One row per cell: the kept columns, j from 0, v."""
    return rows.select(*keep, F.posexplode(vector).alias("j", "v"))


def column_stats(rows: DataFrame, vector: str, train: str | None = None) -> DataFrame:
    """(j, n, mean, sd) of each feature over rows where `train` holds; sd has ddof 0, and is 1 where it would be 0."""
    chosen = rows.where(F.col(train)) if train else rows
    per = long(chosen, vector).groupBy("j").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return per.withColumn("sd", F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0)))


def block_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


class Pieces:
    """Cuts batches so that blocks of `width` numbers a row, which is set once it is known, stay within AT_ONCE bytes."""

    def __init__(self) -> None:
        self.width = 0

    def of(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start = 0
        while start < batch.num_rows:
            rows = max(1, AT_ONCE // (8 * self.width)) if self.width else FIRST
            yield batch.slice(start, rows)
            start += rows


def mapped(rows: DataFrame, x: str, f: Callable[..., np.ndarray], name: str, *held: np.ndarray | float) -> DataFrame:
    """Add or replace `name`, f(block x, *held); each task maps pieces of its batches as matrices. A null block gives null.

    f maps each row by itself. `held` is broadcast; pieces without a block that isn't null aren't passed to f.
    """
    sent = rows.sparkSession.sparkContext.broadcast(held)
    others = [c for c in rows.schema.fields if c.name.lower() != name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces()
        for batch in (piece for b in batches for piece in pieces.of(b)):
            column = batch.column(x)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            n = int(there.sum())
            block = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1) if n else np.empty((0, 0))
            values = f(block, *sent.value) if n else block
            pieces.width = max(pieces.width, block.shape[1], values.shape[1])
            ends = np.concatenate(([0], np.cumsum(there * values.shape[1]))).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~there, False)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c.name) for c in others], out], names=[*[c.name for c in others], name])

    return rows.mapInArrow(run, T.StructType([*others, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def linear_map(rows: DataFrame, x: str, matrix: np.ndarray, offset: np.ndarray | float = 0.0, name: str = "mapped") -> DataFrame:
    """Add or replace `name`, the block x times a p x q matrix, plus an offset. Each task multiplies its batches.

    The matrix is broadcast: its size is features by features, whatever the rows. A null block gives null, a null value
    inside one NaN; blocks of another length than p raise.
    """
    return mapped(rows, x, lambda block, b, plus: block @ b + plus, name, np.asarray(matrix, dtype=np.float64), offset)


def grouped(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray | slice]]:
    """The keys that a batch holds and the places of each one's rows."""
    if not keys:
        yield (), slice(None)
        return
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for k in keys:
        coded = batch.column(k).dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    for at in np.split(order, cuts):
        yield tuple(batch.column(k)[int(at[0])].as_py() for k in keys), at


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by keys cut anew, so that none ends within a group of up to `most` rows; larger ones are cut there."""
    held, done = None, 0  # the last group's rows so far, and how many of its rows went before
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        ends = [int(at[-1]) + 1 for _, at in grouped(batch, keys)] if keys else [batch.num_rows]
        start = max((e for e in ends if e < batch.num_rows), default=0)
        cut = start + (batch.num_rows - start + (0 if start else done)) // most * most - (0 if start else done)
        cut = max(cut, start)
        if cut:
            yield batch.slice(0, cut)
        done = (cut - start + (0 if start else done)) % most
        held = batch.slice(cut) if cut < batch.num_rows else None
    if held is not None:
        yield held


class Sums:
    """Arrays by key, added up in a task; when they exceed HELD bytes they are passed on and begun again."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.sums, self.bytes = schema, {}, 0

    def add(self, key: tuple, values: np.ndarray) -> None:
        if key in self.sums:
            self.sums[key] += values
        else:
            self.sums[key] = np.array(values, dtype=np.float64)
            self.bytes += self.sums[key].nbytes

    def full(self) -> bool:
        return self.bytes > HELD

    def batches(self, rows_of=lambda key, m: [(key, m)]) -> Iterator[pa.RecordBatch]:
        """Rows of (key, array), a few megabytes at a time; rows_of cuts a key's sums into rows. Nothing is held afterwards."""
        kept, size = [], 0
        for key in list(self.sums):
            for row in rows_of(key, self.sums.pop(key)):
                kept.append(row)
                size += row[1].nbytes
                if size > 8 << 20:
                    yield self._batch(kept)
                    kept, size = [], 0
        self.bytes = 0
        if kept:
            yield self._batch(kept)

    def _batch(self, rows: list[tuple[tuple, np.ndarray]]) -> pa.RecordBatch:
        ends = np.concatenate(([0], np.cumsum([len(v) for _, v in rows]))).astype(np.int32)
        arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([v for _, v in rows])))
        keys = [pa.array(c, t) for c, t in zip(zip(*(k for k, _ in rows), strict=True), self.schema.types[:-1], strict=True)]
        return pa.RecordBatch.from_arrays([*keys, arrays], names=self.schema.names)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])


def summed(parts: DataFrame, *keys: str, value: str = "row") -> DataFrame:
    """(keys, value): arrays of equal keys added place by place, after one shuffle of them."""
    schema = parts.select(*keys, value).schema
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(arrow)
        for b in batches:
            column = b.column(value)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))))
            for at, key in enumerate(zip(*(b.column(k).to_pylist() for k in keys), strict=True)):
                sums.add(key, flat[ends[at] : ends[at + 1]])
        yield from sums.batches()

    return parts.select(*keys, value).repartition(*keys).mapInArrow(run, schema)


def _products(rows: DataFrame, x: str, y: str, keys: Sequence[str], weight: str | None, turn: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(keys, i, row): sums over rows of x_i times y (by weight, if given); where x is y, row begins at i.

    turn: maps rows of block y (of both, where x is y) before they are multiplied. Rows with a null block are left out in the tasks,
    since a filter on a column that Python makes would have it made once more.
    """
    columns = list(dict.fromkeys([*keys, x, y, *([weight] if weight else [])]))
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("i", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow(schema)
    cut = lambda key, m: [((*key, i), r[i:] if x == y else r) for i, r in enumerate(m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, pieces = Sums(arrow), Pieces()
        for b in (piece for batch in batches for piece in pieces.of(batch)):
            if b.column(x).null_count or b.column(y).null_count:
                b = b.filter(pc.and_(b.column(x).is_valid(), b.column(y).is_valid()))
                if not b.num_rows:
                    continue
            right = turn(block_of(b, y)) if turn else block_of(b, y)
            left = right if x == y else block_of(b, x)
            pieces.width = max(left.shape[1], right.shape[1])
            if weight:
                right = right * b.column(weight).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
            for key, at in grouped(b, keys):
                sums.add(key, left[at].T @ right[at])
            if sums.full():
                yield from sums.batches(cut)
        yield from sums.batches(cut)

    return summed(rows.select(*columns).mapInArrow(run, schema), *keys, "i")


def product_rows(rows: DataFrame, one: str, y: str, *keys: str) -> DataFrame:
    """(keys, row): sums over rows of y (an array) times the only number of `one`, for each group of keys."""
    return _products(rows, one, y, keys, None).drop("i")


def cross_product(rows: DataFrame, x: str, y: str, *keys: str, turn: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(keys, i, j, v): the sum over rows of x_i * y_j, for each group of keys; turn maps rows of y first. Rows with a null block don't count."""
    found = _products(rows, x, y, keys, None, turn)
    if x != y:
        return found.select(*keys, "i", F.posexplode("row").alias("j", "v"))
    upper = found.select(*keys, "i", F.posexplode("row").alias("at", "v")).withColumn("j", F.col("i") + F.col("at"))
    one = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"))
    both = F.when(F.col("at") == 0, F.array(one("i", "j"))).otherwise(F.array(one("i", "j"), one("j", "i")))
    return upper.select(*keys, "v", F.explode(both).alias("c")).select(*keys, "c.i", "c.j", "v")


def participation(gram: DataFrame) -> DataFrame:
    """One row: trace squared by the sum of squares of a symmetric (i, j, v) matrix, which is (sum l)^2 / sum l^2 of its eigenvalues."""
    return gram.agg((F.pow(F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0)), 2) / F.sum(F.col("v") * F.col("v"))).alias("participation_ratio"))


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(i, j, r): Pearson correlations of every feature of x with every one of y, from one pass of sums; null for a constant feature."""
    s = stats(rows, x, y)
    r = s.correlation()
    cells = [(i, j, float(v)) for i, row in enumerate(r) for j, v in enumerate(row)]
    return rows.sparkSession.createDataFrame(cells, "i long, j long, r double")


@dataclass
class Stats:
    """Sufficient statistics of two blocks: n, sums, and uncentred cross-products."""

    n: float
    sx: np.ndarray
    sy: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    def centered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centred X'X, X'Y and Y'Y."""
        mx, my = self.sx / self.n, self.sy / self.n
        return self.xx - self.n * np.outer(mx, mx), self.xy - self.n * np.outer(mx, my), self.yy - self.n * np.outer(my, my)

    def correlation(self) -> np.ndarray:
        cxx, cxy, cyy = self.centered()
        with np.errstate(divide="ignore", invalid="ignore"):
            return cxy / np.sqrt(np.outer(np.diag(cxx), np.diag(cyy)))


def stats(rows: DataFrame, x: str, y: str, weight: str | None = None) -> Stats:
    """Sums over all rows, of p + q features, in one pass: the block [1, x, y] times itself (by weight, if given).

    What returns is half of (1 + p + q)^2 numbers whatever the number of rows.
    """
    return next(iter(stats_by(rows, x, y, weight=weight).values()), None) or unpack(np.zeros((1, 1)), 0)


@dataclass
class Features:
    """`f` maps rows of p numbers to rows of d numbers."""

    p: int
    d: int
    f: Callable[[np.ndarray], np.ndarray]

    def turn(self, u: np.ndarray) -> np.ndarray:
        """[1, x, y] with the features of x in its place."""
        return np.hstack([u[:, :1], self.f(u[:, 1 : 1 + self.p]), u[:, 1 + self.p :]])


def triangles(rows: DataFrame, x: str, y: str, keys: Sequence[str] = (), weight: str | None = None, features: Features | None = None) -> DataFrame:
    """(keys, p, i, row): the upper triangle of the block [1, x, y] times itself for each group of keys, p features being x's.

    features: taken of x in the task that multiplies them, a piece at a time, so that rows are sent as narrow as they are.
    """
    block = F.concat(F.array(F.lit(1.0)), F.col(x).cast("array<double>"), F.col(y).cast("array<double>"))
    part = rows.select(*keys, (F.lit(features.d) if features else F.size(x)).alias("p"), block.alias("_u"), *([F.col(weight).cast("double").alias("_w")] if weight else []))
    return _products(part, "_u", "_u", [*keys, "p"], "_w" if weight else None, features.turn if features else None)


def assemble(i: Sequence[int], rows: Sequence[np.ndarray], p: int) -> Stats:
    """Statistics from the rows of an upper triangle."""
    size = len(i)
    m = np.zeros((size, size))
    for at, row in zip(i, rows, strict=True):
        m[at, at:] = row
    return unpack(m + np.triu(m, 1).T, p)


def stats_by(rows: DataFrame, x: str, y: str, keys: Sequence[str] = (), weight: str | None = None, features: Features | None = None) -> dict[tuple, Stats]:
    """Statistics of each group of keys on the driver (splits, folds: few), of x or of features of it; replicates are solved in tasks instead."""
    found = triangles(rows, x, y, keys, weight, features).toArrow()
    groups: dict[tuple, list[int]] = {}
    for at, key in enumerate(zip(*(found[k].to_pylist() for k in (*keys, "p")), strict=True)):
        groups.setdefault(key, []).append(at)
    i, column = found["i"].to_numpy(), found["row"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    return {key[:-1]: assemble(i[at], [column[a].values.to_numpy(zero_copy_only=False) for a in at], key[-1]) for key, at in groups.items()}


def solve_by(rows: DataFrame, x: str, y: str, keys: Sequence[str], f: Callable[[dict[tuple, Stats]], list[dict]], schema: str, weight: str | None = None) -> DataFrame:
    """(keys, schema): what f tells of {key: statistics} of each group of keys, solved in a task of its own."""

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        s = assemble(part["i"].to_numpy(), part["row"].tolist(), int(part["p"].iloc[0]))
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | r for r in f({key: s})], columns=[*keys, *names])

    found = triangles(rows, x, y, keys, weight)
    types = "".join(f"`{c.name}` {c.dataType.simpleString()}, " for c in found.select(*keys).schema.fields)
    return found.groupBy(*keys).applyInPandas(solve, types + schema)


def unpack(m: np.ndarray, p: int) -> Stats:
    a, b = slice(1, 1 + p), slice(1 + p, None)
    return Stats(m[0, 0], m[0, a], m[0, b], m[a, a], m[a, b], m[b, b])
