"""Fusion of mix scores with the scores of separated stems."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from earmark import constants as C
from earmark.operators.metrics import binary_metrics
from earmark.sources.dims import with_profile


def supported_stem(label: Column, stems: Mapping[str, str] | None = None) -> Column:
    """The one stem that may speak for a label, or null."""
    found = F.lit(None).cast("string")
    for name, stem in (C.STEM_BY_LABEL if stems is None else stems).items():
        found = F.when(label == name, F.lit(stem)).otherwise(found)
    return found


def energy_ratios(stem_samples: DataFrame) -> DataFrame:
    """RMS over both channels per (clip, stem), as share of the clip's sum (0 if the sum is 0)."""
    square = (F.col("l") * F.col("l") + F.col("r") * F.col("r")) / 2
    rms = stem_samples.groupBy("clip_id", "stem").agg(F.sqrt(F.avg(square)).alias("rms"))
    total = F.sum("rms").over(Window.partitionBy("clip_id"))
    return rms.select(
        "clip_id", "stem", F.when(total == 0, 0.0).otherwise(F.col("rms") / total).alias("energy")
    )


def _with_evidence(mix: DataFrame, stem_scores: DataFrame, energy: DataFrame, stems) -> DataFrame:
    """Stem scores and energies of a clip folded to one row (a handful of stems each)."""
    own = supported_stem(F.col("canonical_label"), stems)
    per_label = stem_scores.groupBy("clip_id", "canonical_label").agg(
        F.max(F.when(F.col("stem") == own, F.col("score"))).alias("stem_score"),
        F.bool_or(F.col("stem") == "other").alias("has_other"),
        F.map_from_entries(F.collect_list(F.struct("stem", "score"))).alias("stem_scores"),
    )
    per_clip = energy.groupBy("clip_id").agg(
        F.map_from_entries(F.collect_list(F.struct("stem", "energy"))).alias("stem_energy_ratios")
    )
    return (
        mix.withColumn("stem", own)
        .join(per_label, ["clip_id", "canonical_label"], "left")
        .join(per_clip, "clip_id", "left")
        .withColumn(
            "stem_energy", F.coalesce(F.try_element_at("stem_energy_ratios", F.col("stem")), F.lit(0.0))
        )
    )


def _fused(score: Column) -> Column:
    reliability = F.least(F.lit(1.0), F.col("stem_energy") / C.FULL_RELIABILITY_ENERGY)
    return F.greatest(score, F.col("stem_score") * reliability)


def fuse(
    mix: DataFrame,
    stem_scores: DataFrame,
    energy: DataFrame,
    stem_spatial: DataFrame,
    profile: str,
) -> DataFrame:
    """Reliability-weighted fusion: a stem may lift unknown to candidate, never to confirmed.

    ``mix``: clip_id, canonical_label, decision, score, pan, width, stability, basis.
    ``stem_spatial``: clip_id, stem, pan, width, stability, basis.
    """
    image = ["pan", "width", "stability", "basis"]
    found = stem_spatial.select(
        "clip_id", "stem", *[F.col(c).alias(f"_stem_{c}") for c in image], F.lit(True).alias("_found")
    )
    joined = _with_evidence(mix, stem_scores, energy, None).join(found, ["clip_id", "stem"], "left")
    spoken = F.col("stem_score").isNotNull()
    low = spoken & (F.col("stem_energy") < C.LOW_ENERGY)
    take = F.coalesce(spoken & ~low & F.col("_found"), F.lit(False))
    fused = with_profile(joined.withColumn("fused_score", _fused(F.col("score"))), profile)
    lifted = (F.col("decision") == C.UNKNOWN) & (F.col("fused_score") >= F.col("candidate"))
    warnings = F.array_compact(
        F.array(
            F.when(low, "supported_stem_energy_too_low"),
            F.when(
                F.coalesce("has_other", F.lit(False)) & F.col("stem").isNull(),
                "other_stem_not_used_for_instrument_identity",
            ),
        )
    )
    return fused.select(
        "clip_id",
        "canonical_label",
        F.when(lifted, C.CANDIDATE).otherwise(F.col("decision")).alias("decision"),
        F.col("score").alias("mix_score"),
        "fused_score",
        *[F.when(take, F.col(f"_stem_{c}")).otherwise(F.col(c)).alias(c) for c in image],
        "stem_scores",
        "stem_energy_ratios",
        warnings.alias("warnings"),
    )


def fuse_for_comparison(
    preds: DataFrame, stem_scores: DataFrame, energy: DataFrame
) -> DataFrame:
    """Evaluation variant of the fusion: no low-energy rule, no stem for voice, and every label
    without a stem carries the warning.

    ``preds``: clip_id, canonical_label, mix_score (further columns are kept).
    """
    stems = {label: stem for label, stem in C.STEM_BY_LABEL.items() if stem != "vocals"}
    unsupported = F.when(F.col("stem").isNull(), "other_stem_not_used_for_instrument_identity")
    return _with_evidence(preds, stem_scores, energy, stems).select(
        *preds.columns,
        _fused(F.col("mix_score")).alias("fused_score"),
        "stem_scores",
        "stem_energy_ratios",
        F.array_compact(F.array(unsupported)).alias("warnings"),
    )


def compare_scores(
    preds: DataFrame, columns: list[str], profile: str, tie_break: list[str]
) -> DataFrame:
    """Metrics at the candidate threshold for several score columns side by side."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    long = preds.selectExpr(
        "canonical_label as label", "target", *tie_break, f"stack({len(columns)}, {pairs}) as (variant, score)"
    )
    leveled = with_profile(long, profile, label="label").withColumnRenamed("candidate", "threshold")
    return binary_metrics(leveled, ["label", "variant"], tie_break=tie_break)
