"""Readers of subject tables, feature blocks, matrices and chunked cohorts, as DataFrames with declared schemas."""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covaria.functions import vectors as V
from covaria.operators import cohort, splits

# Formats and separators by file ending.
FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "parquet": "parquet", "json": "json", "orc": "orc", "npy": "npy", "npz": "npy"}
SEPARATORS = {"csv": ",", "tsv": "\t", "txt": "\t"}


def ending(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def discover_format(path: str) -> str:
    """Format by ending; raises on an unknown one. Whether the path exists is Spark's to say when it reads."""
    if (found := FORMATS.get(ending(path))) is None:
        raise ValueError(f"no reader for {path}; known endings: {', '.join(FORMATS)}")
    return found


def infer_delimiter(path: str) -> str:
    return SEPARATORS.get(ending(path), ",")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, separator: str | None = None) -> DataFrame:
    """A table of any known format. Give a schema for text formats: without one they are read twice to infer it."""
    kind = discover_format(path)
    if kind == "npy":
        return read_matrix(spark, path)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(path, header=True, sep=separator or infer_delimiter(path), inferSchema=schema is None, nanValue="nan")
    return reader.format(kind).load(path)


def infer_column(columns: Sequence[str], explicit: str | None, candidates: Sequence[str]) -> str:
    """The explicit name if it is there, else the first candidate that is."""
    for c in [explicit] if explicit else candidates:
        if c in columns:
            return c
    raise KeyError(f"none of {[explicit] if explicit else list(candidates)} in {list(columns)}")


def feature_vectors(table: DataFrame, key: str, features: Sequence[str] | None = None, name: str = "x") -> DataFrame:
    """(id, vector) of a wide table: given columns, or all numeric ones but the key. Rows with a null or NaN are left out."""
    numeric = [f.name for f in table.schema if isinstance(f.dataType, T.NumericType) and f.name != key]
    wanted = list(features) if features is not None else numeric
    if missing := [c for c in wanted if c not in table.columns]:
        raise KeyError(f"columns not found: {missing}")
    vector = F.array(*[F.col(c).cast("double") for c in wanted])
    return table.select(F.trim(F.col(key).cast("string")).alias("id"), vector.alias(name)).where(V.finite(F.col(name)))


def edge_vectors(table: DataFrame, key: str | None, n: int, name: str = "y") -> DataFrame:
    """(id, vector): matrices become their upper triangles, edge lists stay. Without a key ids are sub_0, sub_1, ... in row order."""
    if key is None:
        table = splits.with_row_index(table.withColumn("_i", F.monotonically_increasing_id()), ["_i"]).withColumn("_id", F.concat(F.lit("sub_"), F.col("row_idx").cast("string"))).drop("_i", "row_idx")
        key = "_id"
    rows = feature_vectors(table, key, None if key != "_id" else [c for c in table.columns if c != "_id"], name)
    return rows.withColumn(name, V.edges_or_matrix(F.col(name), n))


def fisher_z_vectors(rows: DataFrame, name: str = "y", matrix_size: int | None = None, enabled: bool = True, force: bool = False) -> DataFrame:
    """Add `applied` and `n_clipped`, and Fisher-z the rows that look like correlations (or all, if forced)."""
    y = F.col(name)
    apply = F.lit(True) if force else (V.looks_like_correlations(y, matrix_size) & F.lit(enabled))
    marked = rows.withColumn("applied", apply).withColumn("n_clipped", F.when(F.col("applied"), V.clipped(y)).otherwise(F.lit(0).cast("long")))
    return marked.withColumn(name, F.when(F.col("applied"), V.fisher_z(y)).otherwise(y))


def _arrays(content: bytes, key: str | None) -> np.ndarray:
    found = np.load(io.BytesIO(content), allow_pickle=False)
    if isinstance(found, np.ndarray):
        return found
    names = list(found.keys())
    if key is None and len(names) != 1:
        raise ValueError(f"name one of {names}")
    return found[key or names[0]]


def read_matrix(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(path, row, values) of 1- or 2-D arrays in .npy files, or one array of .npz files; a folder or pattern may hold many.

    Files are decoded in tasks, one file at a time; a file's rows follow each other in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                m = np.atleast_2d(_arrays(content, key).astype(np.float64))
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["path", "row", "values"]
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row long, values array<double>")


def with_ids(matrix: DataFrame, ids: DataFrame, name: str = "x") -> DataFrame:
    """(id, vector): matrix rows beside ids of the same place (`row_idx`); as many of both, or it raises."""
    n, m = matrix.count(), ids.count()
    if n != m:
        raise ValueError(f"{n} rows and {m} ids")
    return matrix.join(ids, F.col("row") == F.col("row_idx")).select("id", F.col("values").alias(name))


def decoded(rows: DataFrame, key: str, path: str, decode, name: str = "x") -> tuple[DataFrame, DataFrame]:
    """Vectors of files that rows point to, by a function of a file's bytes: (id, vector), and (id, error) of those that fail.

    Files are joined by path as Spark lists them, so the driver never opens one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, content in zip(b.column("id").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    out.append((i, [float(v) for v in decode(content)], None))
                except Exception as e:  # noqa: BLE001  the error is the row's result
                    out.append((i, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.list_(pa.float64()), pa.string()))], names=["id", name, "error"])

    spark = rows.sparkSession
    paths = [r[0] for r in rows.select(path).distinct().limit(100_001).collect()]
    if len(paths) > 100_000:
        raise ValueError("more than 100,000 files; give a folder to read_matrix")
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("_p"), "content")
    joined = rows.select(F.col(key).cast("string").alias("id"), F.regexp_replace(F.col(path), "^file:/*", "/").alias("_p")).join(files, "_p").select("id", "content")
    done = joined.mapInArrow(run, f"id string, {name} array<double>, error string")
    return done.where("error IS NULL").drop("error"), done.where("error IS NOT NULL").select("id", "error")


def read_chunks(spark: SparkSession, path: str, expected: int | None = None, key: str = "id", status: str = "status") -> DataFrame:
    """Rows with status ok of a chunked Parquet cohort; with `expected`, so many files must be there. Of a repeated key the first file's row stays."""
    rows = spark.read.parquet(path).withColumn("_file", F.input_file_name())
    if expected is not None and (n := rows.select("_file").distinct().count()) != expected:
        raise ValueError(f"{n} chunks, {expected} expected")
    good = rows.where(F.lower(F.trim(F.col(status).cast("string"))) == "ok")
    rest = [c for c in good.columns if c not in (key, "_file")]
    return good.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_file", *[c for c in rest if not isinstance(good.schema[c].dataType, T.MapType)])).alias("_r")).select(key, "_r.*")


def with_paths(subjects: DataFrame, template: str, key: str = "id", name: str = "path") -> DataFrame:
    """Add the path of each subject's file from a template with {id}."""
    before, after = template.split("{id}")
    return subjects.withColumn(name, F.concat(F.lit(before), F.col(key).cast("string"), F.lit(after)))


def load_covariates(table: DataFrame, ids: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Numeric covariates of the ids in one row each, nulls as the median over all requested ids."""
    joined = cohort.reindex(ids, table.select(key, *[F.col(c).try_cast("double").alias(c) for c in columns]), key)
    medians = {c: q[0] for c, q in splits.quantiles_of(joined, {c: F.col(c) for c in columns}, [0.5]).items()}
    return joined.select(key, *[F.coalesce(F.col(c), F.lit(medians[c])).alias(c) for c in columns])


def load_contracts(tables: Mapping[str, DataFrame], splits_: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Tables x1, y1, x2, y2 (id, vector) and splits of the first cohort, after all checks.

    Ids are unique and alike in both blocks of a cohort, cohorts are disjoint, every split id is known, and vectors of a
    block are of one length that both cohorts share. Each check names what breaks it.
    """
    for name, t in tables.items():
        cohort.assert_unique(t, key, name)
    for a, b in (("x1", "y1"), ("x2", "y2")):
        cohort.assert_all_found(tables[a], tables[b], key)
        cohort.assert_all_found(tables[b], tables[a], key)
    cohort.assert_disjoint(tables["x1"], tables["x2"], key)
    cohort.assert_all_found(splits_, tables["x1"], key)
    for a, b in (("x1", "x2"), ("y1", "y2")):
        sizes = {r[0] for t in (a, b) for r in tables[t].select(F.size([c for c in tables[t].columns if c != key][0])).distinct().limit(3).collect()}
        if len(sizes) > 1:
            raise ValueError(f"{a} and {b} have vectors of sizes {sorted(sizes)}")
    return dict(tables) | {"splits": splits_}


def variant(blocks: DataFrame, name: str) -> DataFrame:
    """One of the variants (raw, resid, scaled) of a table partitioned by `variant`, which prunes the others' files."""
    return blocks.where(F.col("variant") == name).drop("variant")


def stream_finite(spark: SparkSession, path: str, key: str, column: str) -> DataFrame:
    """Two columns of a very wide text table, rows with a finite number only; other columns are never parsed."""
    names = spark.read.text(path).first()["value"].split(infer_delimiter(path))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    value: Column = F.col(column).try_cast("double")
    return read_table(spark, path, schema).select(key, value.alias(column)).where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf")))
