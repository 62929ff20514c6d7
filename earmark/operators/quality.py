"""Quality gates, warnings, channel shaping and score validation.

Sample tables are long: one row per (clip_id, i) with ``ch``, the array of channel values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from earmark import constants as C


def _total(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + term(x))


def clip_measures(samples: DataFrame) -> DataFrame:
    """Mergeable per-clip sums: one pass, combined before the shuffle, safe for a hot clip."""
    ch = F.col("ch")
    broken = F.exists(ch, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    # NaN compares above every number in Spark, so it is excluded by name
    loud = _total(ch, lambda x: F.when(~F.isnan(x) & (F.abs(x) >= C.CLIP_LEVEL), 1.0).otherwise(0.0))
    values = F.sum(F.size(ch))
    return samples.groupBy("clip_id").agg(
        F.count("*").alias("n_samples"),
        F.sqrt(F.try_divide(F.sum(_total(ch, lambda x: x * x)), values)).alias("rms"),
        F.bool_or(broken).alias("not_finite"),
        F.try_divide(F.sum(loud), values).alias("clipped_ratio"),
    )


def quality_gate(clips: DataFrame, samples: DataFrame) -> DataFrame:
    """First failing check per clip as ``reason``; null means accepted.

    ``clips``: clip_id, suffix, sample_rate, channels.
    """
    measured = clips.join(clip_measures(samples), "clip_id", "left")
    n = F.coalesce(F.col("n_samples"), F.lit(0))
    duration = n / F.col("sample_rate")
    rate = F.col("sample_rate")
    reason = (
        F.when(~F.lower("suffix").isin(*C.ALLOWED_SUFFIXES), "unsupported_suffix")
        .when((rate < C.MIN_SAMPLE_RATE) | (rate > C.MAX_SAMPLE_RATE), "abnormal_sample_rate")
        .when(n == 0, "empty")
        .when(F.col("not_finite"), "not_finite")
        .when(duration > C.MAX_DURATION_S, "too_long")
        .when(F.col("rms") < C.MIN_RMS, "silent")
    )
    return measured.select("clip_id", duration.alias("duration_s"), "rms", reason.alias("reason"))


def clip_warnings(clips: DataFrame, samples: DataFrame) -> DataFrame:
    """Array of warnings per clip (mono, more than two channels, clipping)."""
    clipping = F.coalesce(F.col("clipped_ratio"), F.lit(0.0)) > C.CLIP_RATIO
    found = F.array(
        F.when(F.col("channels") == 1, "source_is_mono"),
        F.when(F.col("channels") > 2, "multichannel_downmixed_to_first_two_channels"),
        F.when(clipping, "severe_clipping_detected"),
    )
    measured = clips.join(clip_measures(samples).select("clip_id", "clipped_ratio"), "clip_id", "left")
    return measured.select("clip_id", F.array_compact(found).alias("warnings"))


def shape_channels(samples: DataFrame) -> DataFrame:
    """Mono mean over all channels, and a stereo pair (mono doubled, or the first two)."""
    ch = F.col("ch")
    left = F.element_at(ch, 1)
    return samples.select(
        "clip_id",
        "i",
        (_total(ch, lambda x: x) / F.size(ch)).alias("mono"),
        left.alias("l"),
        F.when(F.size(ch) > 1, F.get(ch, F.lit(1))).otherwise(left).alias("r"),
    )


def score_fault(target: str = "target", score: str = "score") -> Column:
    """Why a labelled score cannot be used, or null."""
    t, s = F.col(target), F.col(score).cast("double")
    finite = ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))
    return (
        F.when(t.isNull() | ~t.isin(0, 1), "target_not_binary")
        .when(s.isNull() | ~finite, "score_not_finite")
    )


def judged(df: DataFrame, *, target: str = "target", score: str = "score") -> DataFrame:
    """Scores clipped to [0, 1] and ``_fault``, why a row is unusable; an aggregate takes its maximum along."""
    clipped = F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0))
    return df.withColumn("_fault", score_fault(target, score)).withColumn(score, clipped)


def sound(aggregated: DataFrame) -> DataFrame:
    """Aggregated rows without their ``_fault``; one that isn't null fails the job with its reason."""
    reason = F.concat(F.lit("unusable labelled score: "), F.col("_fault"))
    fine = F.when(F.col("_fault").isNull(), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean"))
    return aggregated.filter(fine).drop("_fault")


def validate_scores(
    df: DataFrame, *, target: str = "target", score: str = "score", on_bad: str = "fail"
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Scores clipped to [0, 1]; a bad row fails the job or goes to a second table with its reason."""
    fault = score_fault(target, score)
    s = F.col(score).cast("double")
    clipped = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    if on_bad == "fail":
        checked = F.when(fault.isNull(), clipped).otherwise(
            F.raise_error(F.concat(F.lit("unusable labelled score: "), fault)).cast("double")
        )
        return df.withColumn(score, checked)
    if on_bad != "quarantine":
        raise ValueError("on_bad must be 'fail' or 'quarantine'")
    good = df.filter(fault.isNull()).withColumn(score, clipped)
    bad = df.withColumn("reason", fault).filter(F.col("reason").isNotNull())
    return good, bad


def applicable(
    df: DataFrame, split: str, *, label: str | None = None, dataset: str | None = None
) -> DataFrame:
    """Rows of a split (and label, dataset) with a judgment; a missing one is never a negative."""
    kept = df.filter((F.col("split") == split) & F.col("target").isNotNull())
    if label is not None:
        kept = kept.filter(F.col("label") == label)
    return kept if dataset is None else kept.filter(F.col("dataset") == dataset)


def result_warnings(
    clip_notes: DataFrame, spatial_notes: DataFrame, decisions: DataFrame
) -> DataFrame:
    """All warnings of a clip. ``decisions``: clip_id, decision, has_timbre."""
    state = decisions.groupBy("clip_id").agg(
        F.bool_or(F.col("decision") == C.CONFIRMED).alias("confirmed"),
        F.bool_or("has_timbre").alias("timbre"),
    )
    none = F.array().cast("array<string>")
    closing = F.array_compact(
        F.array(
            F.when(F.coalesce("confirmed", F.lit(False)), "confirmed_results_require_human_review"),
            F.when(~F.coalesce("timbre", F.lit(False)), "per_instrument_timbre_requires_reliable_stems"),
        )
    )
    return (
        clip_notes.select("clip_id", F.col("warnings").alias("own"))
        .join(spatial_notes.select("clip_id", F.col("warnings").alias("spatial")), "clip_id", "left")
        .join(state, "clip_id", "left")
        .select(
            "clip_id",
            F.concat(F.coalesce("own", none), F.coalesce("spatial", none), closing).alias("warnings"),
        )
    )


def with_failures(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Split rows into usable ones and failures with a reason; the run goes on either way."""
    marked = df.withColumn("error", reason)
    return marked.filter(F.col("error").isNull()).drop("error"), marked.filter(F.col("error").isNotNull())


def exit_code(failures: DataFrame) -> int:
    """0 for a clean run, 2 when anything failed."""
    return 0 if failures.isEmpty() else 2


def note_rows(notes: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """One row per warning with its position, for flat sinks."""
    return notes.select(*keys, F.posexplode("warnings").alias("position", "warning"))
