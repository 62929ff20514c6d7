"""Review forms: field expansion and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earmark import constants as C

FIELDS = [
    "field_id", "field_name", "instrument_label", "value", "decision", "model_score", "source",
    "requires_review", "reason",
]


def _field(name: str, value: Column, decision: Column, score: Column, source: Column,
           review: Column, reason: Column) -> Column:
    label = F.col("canonical_label")
    parts = {
        "field_id": F.concat(label, F.lit(f".{name}")),
        "field_name": F.lit(name),
        "instrument_label": label,
        "value": value.cast("string"),
        "decision": decision,
        "model_score": score.cast("double"),
        "source": source,
        "requires_review": review,
        "reason": reason,
    }
    return F.struct(*[column.alias(key) for key, column in parts.items()])


def _unavailable(name: str, reason: str) -> Column:
    null = F.lit(None)
    return _field(name, null, F.lit(C.UNKNOWN), null, F.lit("unavailable"), F.lit(True), F.lit(reason))


def _pick(open_: Column, this: Column, that: Column) -> Column:
    return F.when(open_, this).otherwise(that)


def _spatial(name: str, column: str) -> Column:
    missing = F.col("basis") == C.NO_STEM_BASIS
    decided = F.col(column) != "unknown"
    decision = F.when(decided, F.col("decision")).otherwise(C.UNKNOWN)
    present = _field(
        name,
        F.when(decided, F.col(column)),
        decision,
        F.col("score"),
        F.concat(F.lit("instrument.spatial:"), F.col("basis")),
        decision != C.CONFIRMED,
        F.when(decided, C.REASON_STEM).otherwise(C.REASON_STEM_UNDECIDED),
    )
    return _pick(missing, _unavailable(name, C.REASON_NO_STEM), present)


def expand_form(results: DataFrame) -> DataFrame:
    """Form fields of every clip: one name field per label, eight more per detected label, and one
    count field per clip.

    ``results``: clip_id, canonical_label, decision, score, pan, width, stability, basis, timbre
    (JSON text or null). Only a label's own stem feeds its spatial fields, never the clip's mix.
    """
    decision, score = F.col("decision"), F.col("score")
    detected = decision != C.UNKNOWN
    name = _field(
        "instrument_name",
        F.when(detected, F.col("canonical_label")),
        decision,
        score,
        F.lit("instrument_model"),
        decision != C.CONFIRMED,
        F.when(decision == C.CONFIRMED, C.REASON_NAME_CONFIRMED)
        .when(decision == C.CANDIDATE, C.REASON_NAME_CANDIDATE)
        .otherwise(C.REASON_NAME_UNKNOWN),
    )
    timbre = _field(
        "timbre", F.col("timbre"), decision, score, F.lit("instrument_stem_timbre"), F.lit(True),
        F.lit(C.REASON_TIMBRE),
    )
    special = {
        "pan": _spatial("pan", "pan"),
        "width": _spatial("width", "width"),
        "movement": _spatial("movement", "stability"),
        "timbre": _pick(F.col("timbre").isNotNull(), timbre, _unavailable("timbre", C.REASON_NO_SIGNAL)),
    }
    more = [special.get(f) if f in special else _unavailable(f, C.REASON_NO_SIGNAL) for f in C.DETECTED_FIELDS]
    per_label = results.select(
        "clip_id",
        F.explode(_pick(detected, F.array(name, *more), F.array(name))).alias("_field"),
    ).select("clip_id", *[F.col(f"_field.{c}").alias(c) for c in FIELDS])

    found = F.col("n_detected") > 0
    counts = results.groupBy("clip_id").agg(
        F.count_if(detected).alias("n_detected"),
        F.count_if(decision == C.CONFIRMED).alias("n_confirmed"),
        F.max(F.when(detected, score)).alias("best"),
    )
    per_clip = counts.select(
        "clip_id",
        F.lit("global.instrument_count").alias("field_id"),
        F.lit("instrument_count").alias("field_name"),
        F.lit(None).cast("string").alias("instrument_label"),
        F.when(found, F.col("n_detected").cast("string")).alias("value"),
        F.when(found & (F.col("n_detected") == F.col("n_confirmed")), C.CONFIRMED)
        .when(found, C.CANDIDATE)
        .otherwise(C.UNKNOWN)
        .alias("decision"),
        F.col("best").cast("double").alias("model_score"),
        F.lit("confirmed_or_candidate_instrument_count").alias("source"),
        F.lit(True).alias("requires_review"),
        F.lit(C.REASON_COUNT).alias("reason"),
    )
    return per_label.unionByName(per_clip)


def form_summary(fields: DataFrame) -> DataFrame:
    """Fields per decision and the coverages, per clip (a clip without fields has no row)."""
    counts = fields.groupBy("clip_id").agg(
        *[F.count_if(F.col("decision") == d).alias(d) for d in C.DECISIONS], F.count("*").alias("total")
    )
    return counts.select(
        "*",
        (F.col("confirmed") / F.col("total")).alias("confirmed_coverage"),
        ((F.col("confirmed") + F.col("candidate")) / F.col("total")).alias("prefill_coverage"),
    )
