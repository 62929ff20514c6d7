"""Configuration dimensions as small tables of literals (fixed size, never data)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from earmark import constants as C
from earmark.functions.columns import literal_table


def taxonomy_dim(spark: SparkSession, taxonomy: Mapping | None = None) -> DataFrame:
    """One row per (canonical label, raw label); a raw label may serve several labels."""
    rows = [
        (label, C.DISPLAY_NAMES.get(label, label), raw, parent, group)
        for label, (raws, parent, group) in (taxonomy or C.TAXONOMY).items()
        for raw in raws
    ]
    return literal_table(
        spark,
        "canonical_label string, display_name string, raw_label string, parent string, exclusive_group string",
        rows,
    )


def label_dim(spark: SparkSession, taxonomy: Mapping | None = None) -> DataFrame:
    """One row per canonical label."""
    rows = [
        (label, C.DISPLAY_NAMES.get(label, label), parent, group)
        for label, (_, parent, group) in (taxonomy or C.TAXONOMY).items()
    ]
    return literal_table(
        spark, "canonical_label string, display_name string, parent string, exclusive_group string", rows
    )


def profile_entries(name: str) -> dict[str, tuple[float, float, bool]]:
    if name not in C.PROFILES:
        raise ValueError(f"Unknown threshold profile: {name}")
    return C.PROFILES[name]


def profile_dim(spark: SparkSession, name: str) -> DataFrame:
    """Thresholds per label of one allowed profile."""
    rows = [
        (label, float(candidate), float(confirmed), auto, C.MINIMUM_VALIDATION_POSITIVES)
        for label, (candidate, confirmed, auto) in profile_entries(name).items()
    ]
    return literal_table(
        spark,
        "canonical_label string, candidate double, confirmed double, auto_confirm boolean, minimum_positives int",
        rows,
    )


def with_profile(df: DataFrame, name: str, label: str = "canonical_label") -> DataFrame:
    """Join thresholds on a label; a label without an entry takes the whole default entry."""
    dim = profile_dim(df.sparkSession, name).withColumnRenamed("canonical_label", label)
    candidate, confirmed, auto = C.PROFILE_FALLBACK
    fill = {"candidate": candidate, "confirmed": confirmed, "auto_confirm": auto,
            "minimum_positives": C.MINIMUM_VALIDATION_POSITIVES}
    return df.join(F.broadcast(dim), label, "left").fillna(fill, subset=list(fill))


def _rule_columns(rule: Mapping) -> dict[str, float | int]:
    if rule["ratio"] > 1:
        raise ValueError("a release ratio above 1 would make the on and off levels overlap")
    enabled, windows = rule["transient"]
    return {"release_ratio": float(rule["ratio"]), "min_duration_s": float(rule["min_duration_s"]),
            "gap_s": float(rule["gap_s"]), "min_windows": int(windows) if enabled else 1}


def interval_fallback() -> dict[str, float | int]:
    """Rule columns of a label that has no rule of its own."""
    return _rule_columns(C.INTERVAL_FALLBACK)


def interval_rule_dim(
    spark: SparkSession, labels: list[str] | None = None, rules: Mapping | None = None
) -> DataFrame:
    """Interval rules per label; each missing key falls back on its own.

    The transient filter falls back as a whole, and a switched-off filter means one window is enough.
    """
    chosen = C.INTERVAL_RULES if rules is None else rules
    rows = []
    for label in labels or list(dict.fromkeys([*C.TAXONOMY, *chosen])):
        rows.append((label, *_rule_columns({**C.INTERVAL_FALLBACK, **chosen.get(label, {})}).values()))
    return literal_table(
        spark,
        "canonical_label string, release_ratio double, min_duration_s double, gap_s double, min_windows int",
        rows,
    )


def norms_dim(spark: SparkSession, norms: Mapping | None = None) -> DataFrame:
    """Timbre norms per label: a low and a high bound for each indicator."""
    names = ["centroid_hz", "hf_ratio", "crest_factor", "onset_strength", "decay_seconds"]
    rows = [
        (label, *[float(bound) for name in names for bound in entry[name]])
        for label, entry in (norms or C.TIMBRE_NORMS).items()
    ]
    columns = ", ".join(f"{name}_{side} double" for name in names for side in ("lo", "hi"))
    return literal_table(spark, f"canonical_label string, {columns}", rows)

