"""Scores to decisions and intervals in one plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from earmark import constants as C
from earmark.operators.decisions import decide, demote_ambiguous
from earmark.functions.ordered import MAX_GROUP_ROWS, join_on, oversized_keys
from earmark.operators.intervals import activity_intervals
from earmark.operators.scores import presence_score, score_statistics
from earmark.sources.dims import interval_fallback, interval_rule_dim, label_dim, with_profile


WINDOW = ("clip_id", "window_idx", "canonical_label", "start_s", "end_s", "score")


def small_clips(scores: DataFrame, *, limit: int = MAX_GROUP_ROWS) -> bool:
    """True when no clip has more than ``limit`` rows: a count over the clip column alone."""
    return oversized_keys(scores, ["clip_id"], limit) is None


def label_decisions(
    canonical: DataFrame,
    profile: str,
    *,
    taxonomy: Mapping | None = None,
    margin: float = C.SUBTYPE_MARGIN,
    limit: int = MAX_GROUP_ROWS,
    known_small: bool = False,
    keep_window: bool = False,
) -> DataFrame:
    """Statistics, presence score and decision per (clip, canonical label).

    ``keep_window`` makes the statistics read all window columns, so that their shuffle is the very
    one that the intervals use and is written once.
    """
    stats = score_statistics(canonical, profile, limit=limit, known_small=known_small, last_window=keep_window)
    if keep_window:
        stats = stats.filter(F.col("last_window").isNotNull())
    decided = decide(presence_score(stats))
    return demote_ambiguous(decided, taxonomy=taxonomy, margin=margin)


def with_rules(canonical: DataFrame, profile: str, *, rules: Mapping | None = None) -> DataFrame:
    """Canonical scores with the candidate threshold and the interval rules of their label.

    A label that no rule names keeps its windows and gets the fallback rule.
    """
    dim = interval_rule_dim(canonical.sparkSession, rules=rules)
    leveled = with_profile(canonical, profile).withColumnRenamed("candidate", "threshold")
    return leveled.drop("confirmed", "auto_confirm", "minimum_positives").join(
        F.broadcast(dim), "canonical_label", "left"
    ).fillna(interval_fallback())


def label_intervals(
    canonical: DataFrame, profile: str, *, rules: Mapping | None = None, slice_rows: float | None = None
) -> DataFrame:
    """Activity intervals per (clip, canonical label) at the candidate threshold; give the
    rows of a slice where a clip may be too large for one task."""
    return activity_intervals(with_rules(canonical, profile, rules=rules), slice_rows=slice_rows)


def label_activity(
    canonical: DataFrame,
    profile: str,
    *,
    taxonomy: Mapping | None = None,
    rules: Mapping | None = None,
    sized_by: DataFrame | None = None,
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Every label of every clip with its decision, and one row per interval (or one without).

    ``sized_by`` is the table ``canonical`` was made from; clip sizes are read off it. Only if a
    clip exceeds ``limit`` rows there do the statistics and intervals take their sliced way.
    """
    small = small_clips(canonical if sized_by is None else sized_by, limit=limit)
    scored = canonical.select(*WINDOW)
    if small:
        # both branches below read this one shuffle; each finds its rows already in place
        scored = scored.repartition("clip_id", "canonical_label")
    decisions = label_decisions(
        scored, profile, taxonomy=taxonomy, limit=limit, known_small=small, keep_window=small
    )
    names = label_dim(canonical.sparkSession, taxonomy).select("canonical_label", "display_name")
    intervals = label_intervals(scored, profile, rules=rules, slice_rows=None if small else limit)
    decided = decisions.select("clip_id", "canonical_label", "decision", "score")
    return (
        join_on(decided, intervals, ["clip_id", "canonical_label"], "left")
        .join(F.broadcast(names), "canonical_label", "left")
        .select(
            "clip_id", "canonical_label", "display_name", "decision", "score", "start_s", "end_s",
            "peak_score", "confidence", "n_windows",
        )
    )
