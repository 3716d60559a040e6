"""Writers of cohorts, result tables and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_blocks(blocks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(dataset, variant, block, id, values) as Parquet partitioned by the first three, so readers prune to one block."""
    blocks.write.mode(mode).partitionBy("dataset", "variant", "block").parquet(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def append_rows(rows: DataFrame, path: str) -> None:
    """Add rows to a Parquet log; earlier files aren't touched, so a failed append leaves them as they were."""
    rows.write.mode("append").parquet(path)


def write_splits(folds: DataFrame, path: str) -> None:
    """(id, fold, split) partitioned by fold."""
    folds.write.mode("overwrite").partitionBy("fold").parquet(path)


def write_json(summary: DataFrame, path: str) -> None:
    """A small result table as JSON lines in one file; Spark's commit makes it appear whole or not at all."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def tidy(wide: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, metric, value): one row for each value column."""
    return wide.unpivot(list(keys), list(values), "metric", "value")


def audit_report(counts: Mapping[str, DataFrame]) -> str:
    """Markdown tables of one-row or short results."""
    out = []
    for title, df in counts.items():
        rows = df.limit(200).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(str(v) for v in r) + " |" for r in rows), ""]
    return "\n".join(out)


def coefficient_table(spark, method: str, seed: int, b) -> DataFrame:
    """(method, seed, i, j, b) of a p x q map, for writing beside others."""
    cells = [(method, seed, i, j, float(v)) for i, row in enumerate(b) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, "method string, seed long, i int, j int, b double")


def missing_fits(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(method, seed) that have no coefficients yet."""
    return wanted.join(known.select("method", "seed").distinct(), ["method", "seed"], "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of an append log, the last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
