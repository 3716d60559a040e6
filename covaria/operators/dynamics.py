"""State sequences of subjects: runs, dwell, transitions, switching, entropy, centroids and per-subject summaries.

A sequence is a table of (subject, order columns, state). Rows of one subject are ordered in one window unless `bucket`
is given, a column that never decreases along a subject's sequence (a day, say): then only rows of one bucket are
ordered together and buckets are stitched at their borders, so that a subject with very many rows is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keyed(seq: DataFrame, subject: str, bucket: Column) -> DataFrame:
    """Add `_k`, subject and bucket in a struct: it is never null itself, so nulls inside are keys like others and plain joins hold."""
    return seq.withColumn("_k", F.struct(F.col(subject).alias("s"), bucket.alias("b")))


def followed(seq: DataFrame, subject: str, order: Sequence[str], state: str, bucket: Column | None = None) -> DataFrame:
    """Add `next`, the state after each row's (null after a subject's last row)."""
    if bucket is None:
        return seq.withColumn("next", F.lead(state).over(Window.partitionBy(subject).orderBy(*order)))
    rows = _keyed(seq, subject, bucket)
    heads = rows.groupBy("_k").agg(F.min_by(state, F.struct(*order)).alias("_head"))
    later = heads.select("_k", F.lead("_head").over(Window.partitionBy("_k.s").orderBy("_k.b")).alias("_after"))
    inner = Window.partitionBy("_k").orderBy(*order)
    rows = rows.withColumn("_next", F.lead(state).over(inner)).withColumn("_end", F.lead(F.lit(1)).over(inner).isNull())
    return rows.join(later, "_k").withColumn("next", F.when(F.col("_end"), F.col("_after")).otherwise(F.col("_next"))).drop("_k", "_after", "_next", "_end")


def _runs_by_bucket(seq: DataFrame, subject: str, order: Sequence[str], state: str, bucket: Column) -> DataFrame:
    """Runs are counted within each bucket, from 0 where the first goes on from the bucket before; earlier buckets' runs are added.

    All rows are dealt once, by subject and bucket; what is joined to them and grouped after that keeps the same key.
    """
    rows = _keyed(seq, subject, bucket).select("_k", F.col(state).alias("_state"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    by = [f"_o{i}" for i in range(len(order))]
    inner, outer = Window.partitionBy("_k").orderBy(*by), Window.partitionBy("_k.s").orderBy("_k.b")
    last = rows.groupBy("_k").agg(F.max_by(F.struct(F.col("_state").alias("s")), F.struct(*by)).alias("_last"))
    rows = rows.join(last.select("_k", F.lag("_last").over(outer).alias("_prev")), "_k")
    goes_on = F.when(F.row_number().over(inner) > 1, F.lag("_state").over(inner).eqNullSafe(F.col("_state"))).otherwise(F.col("_prev").isNotNull() & F.col("_prev.s").eqNullSafe(F.col("_state")))
    local = rows.withColumn("_begun", F.when(goes_on, 0).otherwise(1)).withColumn("_local", F.sum("_begun").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    short = local.groupBy("_k", "_local", "_state").agg(F.count("*").alias("_n"))
    begun = short.groupBy("_k").agg(F.max("_local").alias("_begun"))
    earlier = begun.select("_k", F.coalesce(F.sum("_begun").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    placed = short.join(earlier, "_k").select(F.col("_k.s").alias(subject), (F.col("_earlier") + F.col("_local")).alias("run"), F.col("_state").alias(state), "_n")
    return placed.groupBy(subject, "run", state).agg(F.sum("_n").alias("length"))


def runs(seq: DataFrame, subject: str, order: Sequence[str], state: str, bucket: Column | None = None) -> DataFrame:
    """Maximal runs of equal states: subject, run (from 1), state, length."""
    if bucket is not None:
        return _runs_by_bucket(seq, subject, order, state, bucket)
    w = Window.partitionBy(subject).orderBy(*order)
    before = F.lag(state).over(w)
    begun = F.when(before.eqNullSafe(F.col(state)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = seq.select(subject, state, *[c for c in order if c not in (subject, state)], begun.alias("_begun"))
    numbered = numbered.withColumn("run", F.sum("_begun").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(subject, "run", state).agg(F.count("*").alias("length"))


def dwell(seq: DataFrame, subject: str, order: Sequence[str], state: str, bucket: Column | None = None) -> DataFrame:
    """Mean run length for each subject and state that it visits."""
    return runs(seq, subject, order, state, bucket).groupBy(subject, state).agg(F.avg("length").alias("dwell"), F.count("*").alias("visits"))


def transitions(seq: DataFrame, subject: str, order: Sequence[str], state: str, bucket: Column | None = None) -> DataFrame:
    """Counts of consecutive pairs, equal states included: subject, from_state, to_state, n."""
    pairs = followed(seq, subject, order, state, bucket).where("next IS NOT NULL")
    return pairs.groupBy(subject, F.col(state).alias("from_state"), F.col("next").alias("to_state")).agg(F.count("*").alias("n"))


def transition_probabilities(counted: DataFrame, subject: str) -> DataFrame:
    """Add `p`, the count's share of its row (subject, from_state)."""
    total = F.sum("n").over(Window.partitionBy(subject, "from_state"))
    return counted.withColumn("p", F.col("n") / F.greatest(total, F.lit(1)))


def switching(counted: DataFrame, subject: str) -> DataFrame:
    """switching_rate: changes by all pairs (one at least); transition_entropy: -sum p ln p over the subject's pairs."""
    total = F.sum("n").over(Window.partitionBy(subject))
    p = F.col("n") / total
    shares = counted.select(subject, "from_state", "to_state", "n", p.alias("p"))
    return shares.groupBy(subject).agg(
        (F.sum(F.when(F.col("from_state") != F.col("to_state"), F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("switching_rate"),
        (-F.sum(F.col("p") * F.log("p"))).alias("transition_entropy"),
    )


def cohort_transitions(counted: DataFrame) -> DataFrame:
    """Counts and shares of pairs over all subjects."""
    per = counted.groupBy("from_state", "to_state").agg(F.sum("n").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def centroids(seq: DataFrame, state: str, vector: str, states: Sequence) -> DataFrame:
    """Mean vector of each state as (state, j, v); a state that no row has gets zeros."""
    long = seq.select(F.col(state).alias("state"), F.posexplode(vector).alias("j", "v"))
    means = long.groupBy("state", "j").agg(F.avg("v").alias("v"))
    dims = long.groupBy("j").agg(F.count("*").alias("_n")).select("j")
    wanted = seq.sparkSession.createDataFrame([(s,) for s in states], seq.select(F.col(state).alias("state")).schema)
    return F.broadcast(wanted).crossJoin(dims).join(means, ["state", "j"], "left").select("state", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def subject_summary(seq: DataFrame, subject: str, order: Sequence[str], state: str, states: Sequence[str], energy: str | None = None, bucket: Column | None = None) -> DataFrame:
    """One row per subject: n, occupancy, dwell and mean energy of each state, transition counts and probabilities of each
    pair, switching_rate and transition_entropy. States that a subject doesn't visit have zeros.

    Column names end in the state's place in `states`: occ_0, dwell_0, energy_0, tc_0_1, tp_0_1.
    """
    place = {s: i for i, s in enumerate(states)}
    is_state = lambda s, c=state: F.col(c) == F.lit(s)
    n = F.count("*")
    per = seq.groupBy(subject).agg(
        n.alias("n"), *[(F.count_if(is_state(s)) / n).alias(f"occ_{i}") for s, i in place.items()],
        *[F.coalesce(F.avg(F.when(is_state(s), F.col(energy))), F.lit(0.0)).alias(f"energy_{i}") for s, i in place.items() if energy],
    )
    stay = runs(seq, subject, order, state, bucket).groupBy(subject).agg(*[F.coalesce(F.avg(F.when(is_state(s), F.col("length"))), F.lit(0.0)).alias(f"dwell_{i}") for s, i in place.items()])
    counted = transitions(seq, subject, order, state, bucket)
    cell = lambda a, b: F.sum(F.when((F.col("from_state") == F.lit(a)) & (F.col("to_state") == F.lit(b)), F.col("n")).otherwise(0))
    row = lambda a: F.sum(F.when(F.col("from_state") == F.lit(a), F.col("n")).otherwise(0))
    grid = [(a, b) for a in states for b in states]
    pairs = counted.groupBy(subject).agg(
        *[cell(a, b).alias(f"tc_{place[a]}_{place[b]}") for a, b in grid], *[(cell(a, b) / F.greatest(row(a), F.lit(1))).alias(f"tp_{place[a]}_{place[b]}") for a, b in grid]
    )
    wide = per.join(stay, subject).join(pairs, subject, "left").join(switching(counted, subject), subject, "left")
    zero = {c: 0 for c in wide.columns if c.startswith("tc_")} | {c: 0.0 for c in wide.columns if c.startswith("tp_") or c in ("switching_rate", "transition_entropy")}
    return wide.fillna(zero)


def relabel(rows: DataFrame, label: str) -> DataFrame:
    """Add `state`, labels numbered from 0 in sorted order; labels are few, so only they are sorted together."""
    known = rows.select(label).distinct().withColumn("state", F.row_number().over(Window.orderBy(label)) - 1)
    return rows.join(F.broadcast(known) if known.limit(10_001).count() <= 10_000 else known, label)


def clr(rows: DataFrame, keys: Sequence[str], value: str, eps: float = 1e-6) -> DataFrame:
    """Centred log-ratio within each group of keys: ln of (value + eps) by the group's sum, less the group's mean."""
    w = Window.partitionBy(*keys)
    logs = F.log((F.col(value) + eps) / F.sum(F.col(value) + eps).over(w))
    return rows.withColumn("_ln", logs).withColumn("clr", F.col("_ln") - F.avg("_ln").over(w)).drop("_ln")


def state_pairs(means: DataFrame, vectors: str = "v") -> DataFrame:
    """Squared distance of the centroids of every two states a < b, from (state, j, v) rows."""
    a, b = means.alias("a"), means.alias("b")
    joined = a.join(b, (F.col("a.j") == F.col("b.j")) & (F.col("a.state") < F.col("b.state")))
    gap = F.col(f"a.{vectors}") - F.col(f"b.{vectors}")
    return joined.groupBy(F.col("a.state").alias("state_a"), F.col("b.state").alias("state_b")).agg(F.sum(gap * gap).alias("distance2"))


def energy_split(rows: DataFrame, keys: Sequence[str], value: str, coupled: Column) -> DataFrame:
    """Sum of squares of all values and of those where `coupled` holds, with its share."""
    square = F.col(value) * F.col(value)
    return rows.groupBy(*keys).agg(
        F.sum(square).alias("total"), F.sum(F.when(coupled, square).otherwise(0.0)).alias("coupled"), (F.sum(F.when(coupled, square).otherwise(0.0)) / F.sum(square)).alias("share")
    )
