"""Tags, partial judgments and raw model labels mapped to canonical labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from earmark import constants as C
from earmark.sources.dims import taxonomy_dim


def _label_rows(entries: Sequence[tuple[str, Column]]) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(name).alias("label"), value.alias("target")) for name, value in entries])
    ).alias("_entry")


def tags_to_targets(
    df: DataFrame, *, key: str, tags: str, mapping: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One row per (key, label): does the tag set meet the label's tags? Never null.

    The mapping is configuration, so this is a projection without join or shuffle.
    """
    chosen = C.FULL_TAG_TARGETS if mapping is None else mapping
    entries = [
        (label, F.coalesce(F.arrays_overlap(F.col(tags), F.array(*map(F.lit, names))), F.lit(False)))
        for label, names in chosen.items()
    ]
    return df.select(key, _label_rows(entries)).select(key, "_entry.label", "_entry.target")


def fold_partial(
    df: DataFrame,
    *,
    key: str,
    values: str,
    masks: str,
    vocabulary: Sequence[str] = C.PARTIAL_VOCABULARY,
    mapping: Mapping[str, Sequence[str]] | None = None,
    labels: Sequence[str] = C.TARGET_LABELS,
) -> DataFrame:
    """Three-valued target per (key, label) from partly judged member labels.

    SQL's OR is three-valued in the way wanted: true if any member is true, false if all are
    judged false, null otherwise. A label without members stays null.
    """
    chosen = C.PARTIAL_TARGETS if mapping is None else mapping

    def judged(member: str) -> Column:
        at = F.lit(list(vocabulary).index(member))
        return F.when(F.get(F.col(masks), at) != 0, F.get(F.col(values), at) >= 0.5)

    entries = []
    for label in labels:
        folded = F.lit(None).cast("boolean")
        for number, member in enumerate(chosen.get(label, ())):
            folded = judged(member) if number == 0 else folded | judged(member)
        entries.append((label, folded))
    return df.select(key, _label_rows(entries)).select(key, "_entry.label", "_entry.target")


def explode_scores(windows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Dense score vectors to one row per (clip, window, raw label)."""
    names = F.array(*map(F.lit, labels))
    return windows.select(
        "clip_id", "window_idx", "start_s", "end_s", F.posexplode("scores").alias("_pos", "score")
    ).select(
        "clip_id",
        "window_idx",
        "start_s",
        "end_s",
        F.get(names, F.col("_pos")).alias("raw_label"),
        F.col("score").cast("double").alias("score"),
    )


def canonical_scores(scores: DataFrame, taxonomy: Mapping | None = None) -> DataFrame:
    """Long form: highest raw score per (clip, window, canonical label)."""
    dim = taxonomy_dim(scores.sparkSession, taxonomy).select("canonical_label", "raw_label")
    return (
        scores.join(F.broadcast(dim), "raw_label")
        .groupBy("clip_id", "window_idx", "canonical_label")
        .agg(
            F.min("start_s").alias("start_s"),
            F.min("end_s").alias("end_s"),
            F.max(F.col("score").cast("double")).alias("score"),
        )
    )


def canonical_scores_dense(
    windows: DataFrame, labels: Sequence[str], taxonomy: Mapping | None = None
) -> DataFrame:
    """The same from dense vectors as a projection: no shuffle, 16 rows per window instead of 40+.

    A canonical label none of whose raw labels is scored does not appear.
    """
    at = {name: position for position, name in enumerate(labels)}
    entries = []
    for canonical, (raws, _, _) in (taxonomy or C.TAXONOMY).items():
        parts = [F.get(F.col("scores"), F.lit(at[raw])).cast("double") for raw in raws if raw in at]
        if parts:
            best = F.greatest(*parts) if len(parts) > 1 else parts[0]
            entries.append(F.struct(F.lit(canonical).alias("canonical_label"), best.alias("score")))
    return windows.select(
        "clip_id", "window_idx", "start_s", "end_s", F.explode(F.array(*entries)).alias("_entry")
    ).select("clip_id", "window_idx", "_entry.canonical_label", "start_s", "end_s", "_entry.score")


def raw_evidence(scores: DataFrame, taxonomy: Mapping | None = None) -> DataFrame:
    """Highest score per clip, canonical label and raw label.

    Raw labels are reduced per clip first, so the join multiplies only the reduced rows.
    """
    dim = taxonomy_dim(scores.sparkSession, taxonomy).select("canonical_label", "raw_label")
    best = scores.groupBy("clip_id", "raw_label").agg(
        F.max(F.col("score").cast("double")).alias("max_score")
    )
    return best.join(F.broadcast(dim), "raw_label").select(
        "clip_id", "canonical_label", "raw_label", "max_score"
    )


def evidence_map(evidence: DataFrame) -> DataFrame:
    """Nested form: a map raw label -> score per (clip, canonical label); at most 6 entries each."""
    return evidence.groupBy("clip_id", "canonical_label").agg(
        F.map_from_entries(F.collect_list(F.struct("raw_label", "max_score"))).alias("raw_model_scores")
    )
