"""Continuous review-outcome counts per tumbling window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def outcome_counts(events: DataFrame, *, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts per (window, outcome) of a stream with ``event_time`` and ``outcome``.

    In append mode a window is emitted once the watermark has passed its end; later events for it
    are dropped. State is one counter per open window and outcome, combined before the shuffle.
    """
    return (
        events.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", window).alias("w"), "outcome")
        .agg(F.count("*").alias("n_events"))
        .select(
            F.unix_seconds(F.col("w.start")).alias("window_start"),
            F.unix_seconds(F.col("w.end")).alias("window_end"),
            "outcome",
            "n_events",
        )
    )
