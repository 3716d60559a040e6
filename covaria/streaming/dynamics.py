"""State dynamics over streams: windowed counts with watermarks, and transitions with a state per subject."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, subject: str, time: str, state: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, subject, state, n): counts by event-time windows; rows later than the watermark are left out."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    per = timed.groupBy(F.window("_t", window).alias("w"), subject, state).agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), subject, state, "n")


def transitions(events: DataFrame, subject: str, time: str, state: str, late: str = "1 hour") -> DataFrame:
    """(subject, from_state, to_state, n) increments: each subject's last state is kept between batches.

    Rows of one batch are ordered by time; a row older than the last one seen counts from where it arrives. A subject
    that is silent for the watermark's length after its last row is forgotten.
    """
    schema = f"{subject} {dict(events.dtypes)[subject]}, from_state string, to_state string, n long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(batches).sort_values("_t", kind="stable")
        states = ([held.get[0]] if held.exists else []) + rows["_s"].tolist()
        held.update((states[-1],))
        held.setTimeoutTimestamp(max(int(rows["_t"].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + 1)
        pairs = pd.DataFrame({"from_state": states[:-1], "to_state": states[1:]})
        if len(pairs):
            out = pairs.groupby(["from_state", "to_state"]).size().reset_index(name="n")
            out.insert(0, subject, key[0])
            yield out

    timed = events.select(subject, F.col(time).cast("timestamp").alias("_t"), F.col(state).cast("string").alias("_s")).withWatermark("_t", late)
    return timed.groupBy(subject).applyInPandasWithState(step, schema, "last string", "append", "EventTimeTimeout")
