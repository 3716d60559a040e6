"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covaria.llm.common import WORD, broadcast_if_small, materialize, quoted

#: Bins of the ranking variable; only the bin in which a source's quota ends is ranked row by row.
BINS = 4096
#: White space before a word.
SPACES = r"[\x20\x09-\x0D]*"


def sizes(docs: DataFrame, source: str = "source", seed: int = 42, *more: Column) -> DataFrame:
    """doc_id, source, size in words (null text: 0), and `u`, a uniform number in (0, 1) drawn from id, text and seed."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    drawn = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return docs.select(
        "doc_id",
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ((drawn + 0.5) / F.lit(float(1 << 48))).alias("u"),
        digest.alias("digest"),
        *more,
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources by code point, null last, take the weights in turn and share `share` of all sizes. A target stops at
    `most` times its source's size; the excess goes to the others by weight until none is above: that is the
    water level at which sum(min(most * size, weight * level)) is the amount to share (the first level in order of
    cap / weight that its own cap allows, and the highest of those that are allowed). One row per source is all
    that is windowed here.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    levels = (
        capped.withColumn("below", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("w_left", F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("amount", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("amount") - F.coalesce("below", F.lit(0.0))) / F.col("w_left"))
    )
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything)
    return levels.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * level, F.col("cap"))).alias("target"))


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """By source: what it has to give (size, target, whole copies, quota and rate of the rest), and the bin in which its quota ends."""
    goal = targets(sized, weights, share, most)
    means = sized.groupBy("source").agg((F.sum("size") / F.count("*")).alias("mean"))
    goal = materialize(
        goal.join(means.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("quota", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("quota") / F.col("source_size")).otherwise(0.0))
        .select(F.col("source").alias("_s"), "source_size", "target", "mean", "whole", "quota", "rate"),
        "targets",
    )
    bins = _ranked(sized, goal).where("_rank IS NOT NULL").groupBy("_s", "_bin").agg(F.sum("_size").alias("bin_size"), F.first("quota").alias("q"))
    before = F.coalesce(F.sum("bin_size").over(Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = bins.withColumn("before", before).where((F.col("before") < F.col("q")) & (F.col("before") + F.col("bin_size") >= F.col("q")))
    return goal, materialize(last.select(F.col("_s").alias("_t"), F.col("_bin").alias("last_bin"), "before"), "quota-bins")


def _ranked(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """Add the source's goal, the ranking variable (random odds by inclusion odds) and its bin."""
    tilt = 2 * F.col("size") / (F.col("size") + F.col("mean"))
    inclusion = F.col("rate") / F.greatest(1 - F.col("rate"), F.lit(1e-12)) * tilt
    joined = sized.join(broadcast_if_small(goal), F.col("source").eqNullSafe(F.col("_s")), "left")
    rank = F.when((F.col("size") > 0) & (F.col("rate") > 0), F.col("u") / (1 - F.col("u")) / inclusion)
    return joined.withColumn("_rank", rank).withColumn("_bin", F.floor(F.col("_rank") / (1 + F.col("_rank")) * BINS).cast("int")).withColumnRenamed("size", "_size")


def _place(sized: DataFrame, goal: DataFrame, last: DataFrame) -> DataFrame:
    """Add `_part`, the words taken of each row beside its whole copies."""
    placed = _ranked(sized, goal).join(broadcast_if_small(last), F.col("source").eqNullSafe(F.col("_t")), "left")
    whole_in = F.coalesce(F.col("_bin") < F.col("last_bin"), F.lit(False))
    edge = F.coalesce(F.col("_bin") == F.col("last_bin"), F.lit(False))
    away = placed.where(~edge).withColumn("_part", F.when(whole_in, F.col("_size")).otherwise(F.lit(0)))
    # only rows of the bin in which the quota ends are ranked one by one: a BINS-th of a source
    filled = F.coalesce(F.sum("_size").over(Window.partitionBy("source").orderBy("_rank", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    close = placed.where(edge).withColumn("_part", F.greatest(F.lit(0), F.least("_size", F.col("quota") - F.col("before") - filled)))
    return away.unionByName(close)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, source: str = "source", seed: int = 42
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Each source takes floor(target / size) certain whole copies of every document. The rest of its target is a sample
    of fixed size, in words: documents are ranked by random odds u / (1 - u) divided by inclusion odds, which are the
    source's remaining rate tilted towards documents longer than the source's mean (factor 2s / (s + mean)), and taken
    from the lowest rank on until the quota of words is full; the last one is taken in part. A source's words thus
    equal its target up to rounding, and no document exceeds one copy more than the certain ones.

    Null text or a text without words has size 0 and takes 0. Null sources form one source, the last. Repeated rows
    tie and are taken like different rows; ties in rank go by id and text. Runs agree, whatever the partitions.
    An empty table gives no rows. Other columns of docs aren't read.
    """
    sized = materialize(sizes(docs, source, seed), "sizes")
    placed = _place(sized, *_plan(sized, weights, share, most))
    taken = F.col("whole") * F.col("_size") + F.col("_part")
    return placed.select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target",
        F.when(F.col("_size") > 0, taken / F.col("_size")).otherwise(0.0).alias("copies"), taken.cast("long").alias("taken"),
    )


def apply(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, source: str = "source", seed: int = 42
) -> DataFrame:
    """The mix itself, in the columns of docs: each document as many times as mix() takes it.

    Of a document taken in part the first words stay, with the white space before each, and n_chars follows. Documents
    without words aren't in the mix. Columns that docs has beyond the known ones are carried along.
    """
    sized = materialize(sizes(docs, source, seed), "sizes")
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    carried = F.struct(*[F.col(quoted(c)).alias(n) for c, n in names.items()]).alias("_row")
    placed = _place(sizes(docs, source, seed, carried), *_plan(sized, weights, share, most))
    takes = F.array_repeat(F.col("_size"), F.col("whole").cast("int"))
    takes = F.when(F.col("_part") > 0, F.concat(takes, F.array(F.col("_part").cast("long")))).otherwise(takes)
    each = placed.select("_row", "_size", F.explode(takes).alias("_take"))
    text = F.col(f"_row.{names['text']}")
    begun = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACES + WORD), F.lit(0)), 1, F.col("_take").cast("int")), "")
    cut = F.col("_take") < F.col("_size")
    changed = {"text": F.when(cut, begun).otherwise(text)}
    if "n_chars" in names:
        changed["n_chars"] = F.when(cut, F.char_length(begun)).otherwise(F.col(f"_row.{names['n_chars']}")).cast(docs.schema["n_chars"].dataType)
    return each.select(*[changed.get(c, F.col(f"_row.{n}")).alias(c) for c, n in names.items()])
