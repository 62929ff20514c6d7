"""Review analytics: rates, outcome pivots, time savings, overrides and event validation.

Events: session_id, field_id, field_name, label, decision (the last three null without an
original prediction), outcome, elapsed_s.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from earmark import constants as C
from earmark.functions.columns import share
from earmark.functions.ordered import MAX_GROUP_ROWS, order_statistics


def review_rates(events: DataFrame) -> DataFrame:
    """One row of rates; a rate without cases is null. No prediction counts as unknown."""
    made = F.coalesce(F.col("decision"), F.lit(C.UNKNOWN))
    outcome = F.col("outcome")
    confirmed, candidate = made == C.CONFIRMED, made == C.CANDIDATE
    counts = events.agg(
        F.count("*").alias("n_events"),
        F.count_if(confirmed).alias("n_confirmed"),
        F.count_if(candidate).alias("n_candidate"),
        F.count_if(confirmed & (outcome == "accept_as_is")).alias("direct_confirmed"),
        F.count_if(candidate & (outcome == "accept_as_is")).alias("direct_candidate"),
        F.count_if(outcome == "accept_after_edit").alias("edited"),
        F.count_if(outcome == "missing_label").alias("missing"),
        F.count_if(confirmed & (outcome == "reject")).alias("wrong"),
    )
    n = F.col("n_events")
    return counts.select(
        "n_events",
        share(F.col("direct_confirmed"), F.col("n_confirmed")).alias("confirmed_accept_rate"),
        share(F.col("direct_candidate"), F.col("n_candidate")).alias("candidate_accept_rate"),
        share(F.col("edited"), n).alias("usable_after_edit_rate"),
        share(F.col("missing"), n).alias("missing_rate"),
        share(F.col("wrong"), F.col("n_confirmed")).alias("wrong_confirmed_rate"),
        share(F.col("n_confirmed") + F.col("n_candidate"), n).alias("prefill_rate"),
    )


def outcome_pivot(events: DataFrame, by: str) -> DataFrame:
    """Events per outcome, by ``label`` (null is ``global``) or by ``field`` (falls back to the id)."""
    if by == "label":
        group = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("global"))
    elif by == "field":
        group = F.coalesce(F.col("field_name"), F.col("field_id"))
    else:
        raise ValueError("by must be 'label' or 'field'")
    return events.groupBy(group.alias(by)).agg(
        *[F.count_if(F.col("outcome") == name).alias(name) for name in C.OUTCOMES]
    )


def time_savings(sessions: DataFrame, *, limit: int = MAX_GROUP_ROWS) -> DataFrame:
    """Mean and median saving against the manual baseline, and review and model times.

    Sessions: total_review_s, baseline_s (may be null or 0), model_s.
    """
    timed = F.col("baseline_s") > 0
    measured = sessions.select(
        F.col("total_review_s").alias("review"),
        "model_s",
        F.when(timed, 1 - F.col("total_review_s") / F.col("baseline_s")).alias("saving"),
    )
    return order_statistics(
        measured,
        [],
        {"median_saving": ("saving", 0.5), "median_review_s": ("review", 0.5)},
        aggregates={
            "n_sessions": F.count("*"),
            "n_timed": F.count("saving"),
            "mean_saving": F.avg("saving"),
            "mean_review_s": F.avg("review"),
            "mean_model_s": F.avg("model_s"),
        },
        limit=limit,
    )


def append_overrides(overrides: DataFrame, path: str) -> None:
    """Add override events to the log; predictions are never touched."""
    overrides.write.mode("append").parquet(path)


def effective_values(predictions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Value per (analysis_id, field_path) after the latest override, next to the model's own."""
    latest = overrides.groupBy("analysis_id", "field_path").agg(
        F.max_by("new_value", "seq").alias("_new"), F.count("*").alias("n_overrides")
    )
    return predictions.join(latest, ["analysis_id", "field_path"], "left").select(
        "analysis_id",
        "field_path",
        "value",
        F.when(F.col("n_overrides").isNotNull(), F.col("_new")).otherwise(F.col("value")).alias("effective_value"),
        F.coalesce("n_overrides", F.lit(0)).alias("n_overrides"),
    )


def record_events(actions: DataFrame, fields: DataFrame) -> DataFrame:
    """Review events from a reviewer's actions and the form fields shown.

    Actions: analysis_id, seq, field_id, outcome, entered (text or null), profile, shown_s, acted_s.
    An edit or a missing label takes the entered text as final value and says what changed;
    anything else keeps the field's value. A field that was never predicted has no prediction.
    """
    typed = F.col("outcome").isin("accept_after_edit", "missing_label")
    shown = fields.select(
        "analysis_id", "field_id", "field_name", F.col("instrument_label").alias("label"), "decision", "value"
    )
    return actions.join(shown, ["analysis_id", "field_id"], "left").select(
        "analysis_id",
        "seq",
        "field_id",
        "outcome",
        "field_name",
        "label",
        "decision",
        F.when(typed, F.col("entered")).otherwise(F.col("value")).alias("final_value"),
        F.when(typed, F.concat(F.coalesce("value", F.lit("空")), F.lit(" → "), "entered")).alias("edit_description"),
        "profile",
        F.greatest(F.lit(0.0), F.col("acted_s") - F.col("shown_s")).alias("elapsed_s"),
    )


def event_fault():
    """Why a review event cannot be recorded, or null."""
    elapsed = F.col("elapsed_s")
    return (
        F.when(F.col("outcome").isNull() | ~F.col("outcome").isin(*C.OUTCOMES), "unknown_outcome")
        .when(elapsed.isNull() | F.isnan(elapsed) | (elapsed < 0), "negative_elapsed")
        .when(F.col("profile").isNull(), "profile_missing")
    )


def validate_review_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recordable events, and the others with a reason."""
    marked = events.withColumn("reason", event_fault())
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())
