"""Aligned cohorts: key intersection, presence, look-ups, overlap removal, and proofs that they hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align(modalities: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """Inner join of all modalities by key. Columns but the key must differ; a repeated key raises."""
    out = None
    for name, df in modalities.items():
        assert_unique(df, key, name)
        out = df if out is None else out.join(df, key)
    return out


def presence(modalities: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """Over the union of keys, has_<name> for each modality and `complete`.

    One aggregation over the union, so one shuffle whatever the number of modalities.
    """
    names = list(modalities)
    seen = None
    for name, df in modalities.items():
        part = df.select(key, F.lit(name).alias("_m"))
        seen = part if seen is None else seen.union(part)
    has = seen.groupBy(key).agg(*[F.coalesce(F.bool_or(F.col("_m") == n), F.lit(False)).alias(f"has_{n}") for n in names])
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(f"has_{n}")
    return has.withColumn("complete", complete)


def drop_reasons(present: DataFrame, names: Sequence[str]) -> DataFrame:
    """Subjects of the union that miss each modality, as (reason, n); one subject can count under several."""
    counts = present.agg(*[F.count_if(~F.col(f"has_{n}")).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f"missing_{n}").alias("reason"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


def alignment_proof(present: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: keys of each modality, of the union and of the intersection, and how many were dropped."""
    return present.agg(
        *[F.count_if(f"has_{n}").alias(f"n_{n}") for n in names], F.count("*").alias("n_union"), F.count_if("complete").alias("n_complete"), F.count_if(~F.col("complete")).alias("n_dropped")
    )


def reindex(subjects: DataFrame, covariates: DataFrame, key: str = "id") -> DataFrame:
    """Covariates of each subject, null where there are none; of a repeated key the first row by all its columns."""
    rest = [c for c in covariates.columns if c != key]
    first = covariates.groupBy(key).agg(F.min(F.struct(*rest)).alias("_c")).select(key, "_c.*")
    return subjects.select(key).join(first, key, "left")


def remove_overlap(second: DataFrame, first: DataFrame, key: str = "id") -> DataFrame:
    return second.join(first.select(key), key, "left_anti")


def among(rows: DataFrame, kept: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(kept.select(key), key, "left_semi")


def with_gate(subjects: DataFrame, covariate: DataFrame, key: str, value: str) -> DataFrame:
    """One row: subjects, those with a value, and whether all have one (the covariate is then available)."""
    joined = subjects.select(key).join(covariate.select(key, value), key, "left")
    return joined.agg(F.count("*").alias("n"), F.count(value).alias("matched"), (F.count(value) == F.count("*")).alias("available"))


def split_of(rows: DataFrame, splits: DataFrame, key: str = "id", other: str = "unknown") -> DataFrame:
    """Add `split` by key, `other` where a key has none."""
    return rows.join(splits.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit(other)))


def assert_unique(df: DataFrame, key: str, name: str = "table") -> None:
    bad = df.groupBy(key).count().where("count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"{name} has repeated keys: {[r[key] for r in bad]}")


def assert_all_found(wanted: DataFrame, known: DataFrame, key: str = "id") -> None:
    """Every wanted key must be known; the message names the first five that aren't."""
    bad = wanted.join(known.select(key), key, "left_anti").orderBy(key).limit(5).collect()
    if bad:
        raise KeyError(f"ids not found: {[r[key] for r in bad]}")


def assert_disjoint(a: DataFrame, b: DataFrame, key: str = "id") -> None:
    bad = a.join(b.select(key), key, "left_semi").orderBy(key).limit(5).collect()
    if bad:
        raise ValueError(f"ids in both tables: {[r[key] for r in bad]}")


def alignment_hash(ids: DataFrame, key: str = "id", digits: int = 2) -> DataFrame:
    """SHA-256 that is the same for the same ids in any order: (n, sha256).

    Ids with the same leading hex digits of their md5 are sorted, joined with bars and hashed, and so are these digests in
    order of the digits: no task holds more than a bucket's ids. Take more digits for more ids; with 0 it is the digest of
    the whole list. Null ids count in n but not in the digest.
    """
    text = F.col(key).cast("string")
    per = ids.select(F.substring(F.md5(text), 1, digits).alias("b"), text.alias("t")).groupBy("b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("t")), "|"), 256).alias("h"))
    if digits == 0:
        return per.agg(F.sum("n").alias("n"), F.max(F.when(F.col("b").isNotNull(), F.col("h"))).alias("sha256"))
    per = per.withColumn("h", F.when(F.col("b").isNotNull(), F.col("h")))
    return per.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "|"), 256).alias("sha256"))


def row_checksums(rows: DataFrame, key: str, vectors: Sequence[str], digits: int = 6) -> DataFrame:
    """SHA-256 of each row's key and vectors; values are written as whole numbers of 10^-digits, which no engine formats its own way."""
    whole = lambda c: F.array_join(F.transform(c, lambda v: F.round(v * 10**digits).cast("long").cast("string")), ",")
    return rows.select(key, F.sha2(F.concat_ws("|", F.col(key).cast("string"), *[whole(F.col(c)) for c in vectors]), 256).alias("sha256"))


def first_rows(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order, which must tell all rows apart."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def distribution(rows: DataFrame, value: str, flag: str) -> DataFrame:
    """n, mean and standard deviation (ddof 0) of all rows and of each side of a flag, as grouping sets."""
    per = rows.groupingSets([[], [flag]], flag).agg(F.grouping(flag).alias("everything"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return per.select(F.when(F.col("everything") == 1, "all").when(F.col(flag), "train").otherwise("rest").alias("part"), "n", "mean", "sd")
