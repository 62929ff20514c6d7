"""Stem fusion, review forms and exports built from decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark import constants as C
from earmark.operators.forms import expand_form, form_summary
from earmark.operators.fusion import energy_ratios, fuse, fuse_for_comparison
from earmark.operators.decisions import decision
from earmark.operators.review import record_events
from earmark.plans import adapters as A
from earmark.plans.adapters import profile_sql, with_inputs
from earmark.plans.catalog.registry import register, tidied, tidy
from earmark.plans.catalog.scores import EVENTS, events_decisions, score_parts
from earmark.session import scratch_path
from earmark.sources import files
from earmark.sources.dims import with_profile

PROFILE = "calibrated_public_v1"
STEMS = ("drums", "bass", "vocals", "other")


@register("stem_energy_ratios", tidied(with_inputs(["stem_energy"], "SELECT * FROM stem_energy"), "energy"))
def energy_query(spark, d):
    return tidy(energy_ratios(A.stem_samples(spark, d)))


def _stems(spark, d):
    return A.stem_scores(spark, d).filter(F.col("stem") != "mix")


def _stem_spatial(spark, d):
    """A stereo class for the drum stems; the others were not analysed."""
    return _stems(spark, d).filter(F.col("stem") == "drums").select("clip_id", "stem").distinct().select(
        "clip_id",
        "stem",
        F.when(F.col("clip_id") % 4 == 0, "left").otherwise("center").alias("pan"),
        F.lit("narrow").alias("width"),
        F.lit("stable").alias("stability"),
        F.concat(F.lit("separator:"), F.col("stem")).alias("basis"),
    )


def _mix(spark, d):
    mix = A.stem_scores(spark, d).filter(F.col("stem") == "mix").drop("stem")
    leveled = with_profile(mix, PROFILE)
    made = decision(F.col("score"), F.col("candidate"), F.col("confirmed"), F.col("auto_confirm"))
    unknown = F.lit("unknown")
    return leveled.select(
        "clip_id", "canonical_label", made.alias("decision"), "score", unknown.alias("pan"), unknown.alias("width"),
        unknown.alias("stability"), F.lit(C.NO_STEM_BASIS).alias("basis"),
    )


_FUSED = """
    SELECT m.clip_id, m.canonical_label, m.score AS mix_score, m.decision AS mix_decision, p.candidate, m.stem, s.stem_score,
           s.has_other, s.n_stems, coalesce(e.energy, 0.0::DOUBLE) AS energy,
           greatest(m.score, s.stem_score * least(1.0::DOUBLE, coalesce(e.energy, 0.0::DOUBLE) / 0.08::DOUBLE)) AS fused_score
    FROM mix m JOIN profile p USING (canonical_label)
    LEFT JOIN per_label s USING (clip_id, canonical_label) LEFT JOIN stem_energy e ON e.clip_id = m.clip_id AND e.stem = m.stem"""
_OWN = "CASE canonical_label WHEN 'drums' THEN 'drums' WHEN 'percussion' THEN 'drums' WHEN 'bass' THEN 'bass' {voice}END"
_FUSION_PARTS = {
    "profile": profile_sql(PROFILE),
    "mix": f"""SELECT clip_id, canonical_label, score, {_OWN.format(voice="WHEN 'voice' THEN 'vocals' ")} AS stem,
                      CASE WHEN auto_confirm AND score >= confirmed THEN 'confirmed' WHEN score >= candidate THEN 'candidate' ELSE 'unknown' END AS decision
               FROM stem_scores JOIN profile USING (canonical_label) WHERE stem = 'mix'""",
    "per_label": f"""SELECT clip_id, canonical_label, max(score) FILTER (stem = {_OWN.format(voice="WHEN 'voice' THEN 'vocals' ")}) AS stem_score,
                            bool_or(stem = 'other') AS has_other, count(*) AS n_stems
                     FROM stem_scores WHERE stem <> 'mix' GROUP BY clip_id, canonical_label""",
    "fused": _FUSED,
}


@register("fuse_stems", tidied(with_inputs(["stem_scores", "stem_energy"], """
    SELECT clip_id, canonical_label, mix_score, fused_score,
           CASE WHEN mix_decision = 'unknown' AND fused_score >= candidate THEN 'candidate' ELSE mix_decision END AS decision,
           CASE WHEN taken THEN CASE WHEN clip_id % 4 = 0 THEN 'left' ELSE 'center' END ELSE 'unknown' END AS pan,
           CASE WHEN taken THEN 'separator:' || stem ELSE 'no_reliable_stem' END AS basis,
           concat_ws('|', CASE WHEN stem_score IS NOT NULL AND energy < 0.01::DOUBLE THEN 'supported_stem_energy_too_low' END,
                     CASE WHEN stem IS NULL AND has_other THEN 'other_stem_not_used_for_instrument_identity' END) AS warnings,
           coalesce(n_stems, 0) AS n_stems
    FROM (SELECT f.*, f.stem_score IS NOT NULL AND f.energy >= 0.01::DOUBLE AND f.stem = 'drums' AND
                 EXISTS (SELECT 1 FROM stem_scores x WHERE x.clip_id = f.clip_id AND x.stem = f.stem) AS taken FROM fused f)""",
    **_FUSION_PARTS), "mix_score", "fused_score"))
def fuse_query(spark, d):
    fused = fuse(_mix(spark, d), _stems(spark, d), energy_ratios(A.stem_samples(spark, d)), _stem_spatial(spark, d), PROFILE)
    return tidy(fused.select(
        "clip_id", "canonical_label", "mix_score", "fused_score", "decision", "pan", "basis",
        F.concat_ws("|", "warnings").alias("warnings"),
        F.coalesce(F.size(F.map_keys("stem_scores")).cast("long"), F.lit(0)).alias("n_stems"),
    ))


_COMPARED = """
    SELECT clip_id, canonical_label, mix_score, fused_score, coalesce(n_stems, 0) AS n_stems,
           CASE WHEN stem IS NULL THEN 'other_stem_not_used_for_instrument_identity' ELSE '' END AS warnings FROM fused"""


def _compared(spark, d):
    preds = _mix(spark, d).select("clip_id", "canonical_label", F.col("score").alias("mix_score"))
    return fuse_for_comparison(preds, _stems(spark, d), energy_ratios(A.stem_samples(spark, d)))


@register("fuse_for_comparison", tidied(with_inputs(["stem_scores", "stem_energy"], _COMPARED, **_FUSION_PARTS), "mix_score", "fused_score"))
def fuse_comparison_query(spark, d):
    return tidy(_compared(spark, d).select(
        "clip_id", "canonical_label", "mix_score", "fused_score",
        F.coalesce(F.size(F.map_keys("stem_scores")).cast("long"), F.lit(0)).alias("n_stems"),
        F.concat_ws("|", "warnings").alias("warnings"),
    ))


@register("separation_csv", tidied(with_inputs(["stem_scores", "stem_energy"], _COMPARED, **_FUSION_PARTS), "mix_score", "fused_score"))
def separation_csv_query(spark, d):
    """The nine-column comparison file with its three JSON columns, written and read back."""
    path = scratch_path(spark, "separation")
    rows = _compared(spark, d).select(
        F.col("clip_id").cast("string").alias("sample_id"), F.lit("set_a").alias("dataset"),
        F.col("canonical_label").alias("label"), F.lit(1).alias("target"),
        "mix_score", "stem_scores", "fused_score", "stem_energy_ratios", "warnings",
    )
    files.write_comparison_csv(rows, path)
    back = files.read_comparison_csv(spark, path)
    return tidy(back.select(
        F.col("sample_id").cast("long").alias("clip_id"), F.col("label").alias("canonical_label"), "mix_score", "fused_score",
        F.coalesce(F.size(F.map_keys("stem_scores")).cast("long"), F.lit(0)).alias("n_stems"),
        F.concat_ws("|", "warnings").alias("warnings"),
    ))


def form_inputs(spark, d):
    """Decisions with a stem image for some labels and a timbre text for others."""
    decisions = events_decisions(spark, d)
    label, clip = F.col("canonical_label"), F.col("clip_id")
    stemmed = label.isin("drums", "bass") & (clip % 2 == 0)
    image = F.when(stemmed & (clip % 3 == 0), "left").when(stemmed & (clip % 3 == 1), "center").otherwise("unknown")
    return decisions.select(
        "clip_id", "canonical_label", "decision", "score", image.alias("pan"),
        F.when(stemmed, "narrow").otherwise("unknown").alias("width"),
        F.when(stemmed, "stable").otherwise("unknown").alias("stability"),
        F.when(stemmed, F.concat(F.lit("separator:"), label)).otherwise(C.NO_STEM_BASIS).alias("basis"),
        F.when(label == "piano", '{"brightness":"neutral"}').alias("timbre"),
    )


_FORM_ROWS = """
    SELECT *, canonical_label IN ('drums', 'bass') AND clip_id % 2 = 0 AS stemmed, decision <> 'unknown' AS detected,
           CASE WHEN canonical_label IN ('drums', 'bass') AND clip_id % 2 = 0 THEN CASE clip_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'unknown' END
                ELSE 'unknown' END AS pan
    FROM decided"""


def _field_sql(name: str) -> str:
    """One SELECT of a per-label field of a detected label."""
    base = f"SELECT clip_id, canonical_label || '.{name}' AS field_id, '{name}' AS field_name, canonical_label AS instrument_label, "
    nothing = ("NULL::VARCHAR AS value, 'unknown' AS decision, NULL::DOUBLE AS model_score, 'unavailable' AS source, "
               "true AS requires_review, '{reason}' AS reason FROM rows WHERE detected")
    if name in ("pan", "width", "movement"):
        value = {"pan": "pan", "width": "'narrow'", "movement": "'stable'"}[name]
        known = f"({value} <> 'unknown')"
        image = (f"CASE WHEN {known} THEN {value} END, CASE WHEN {known} THEN decision ELSE 'unknown' END, score, "
                 f"'instrument.spatial:separator:' || canonical_label, NOT ({known} AND decision = 'confirmed'), "
                 f"CASE WHEN {known} THEN '{C.REASON_STEM}' ELSE '{C.REASON_STEM_UNDECIDED}' END FROM rows WHERE detected AND stemmed")
        return base + nothing.format(reason=C.REASON_NO_STEM) + " AND NOT stemmed UNION ALL " + base + image
    if name == "timbre":
        text = ("'{\"brightness\":\"neutral\"}', decision, score, 'instrument_stem_timbre', true, "
                f"'{C.REASON_TIMBRE}' FROM rows WHERE detected AND canonical_label = 'piano'")
        return base + nothing.format(reason=C.REASON_NO_SIGNAL) + " AND canonical_label <> 'piano' UNION ALL " + base + text
    return base + nothing.format(reason=C.REASON_NO_SIGNAL)


_FORM = f"""
    SELECT clip_id, canonical_label || '.instrument_name' AS field_id, 'instrument_name' AS field_name, canonical_label AS instrument_label,
           CASE WHEN detected THEN canonical_label END AS value, decision, score AS model_score, 'instrument_model' AS source,
           decision <> 'confirmed' AS requires_review, CASE decision WHEN 'confirmed' THEN '{C.REASON_NAME_CONFIRMED}'
           WHEN 'candidate' THEN '{C.REASON_NAME_CANDIDATE}' ELSE '{C.REASON_NAME_UNKNOWN}' END AS reason FROM rows
    UNION ALL
    SELECT clip_id, 'global.instrument_count', 'instrument_count', NULL, CASE WHEN count_if(detected) > 0 THEN count_if(detected)::BIGINT::VARCHAR END,
           CASE WHEN count_if(detected) = 0 THEN 'unknown' WHEN count_if(detected) = count_if(decision = 'confirmed') THEN 'confirmed' ELSE 'candidate' END,
           max(score) FILTER (detected), 'confirmed_or_candidate_instrument_count', true, '{C.REASON_COUNT}' FROM rows GROUP BY clip_id
    UNION ALL """ + " UNION ALL ".join(_field_sql(name) for name in C.DETECTED_FIELDS)
_FORM_PARTS = score_parts("frame_scores") | {"rows": _FORM_ROWS, "form": _FORM}


@register("expand_form", tidied(with_inputs(EVENTS, "SELECT * FROM form", **_FORM_PARTS), "model_score"))
def expand_form_query(spark, d):
    return tidy(expand_form(form_inputs(spark, d)))


_ACTION_FIELD = {"view": "drums.instrument_name", "click": "bass.pan", "purchase": "piano.instrument_name",
                 "signup": "global.instrument_count", "error": "human_labels.harp"}


@register("recorded_review_events", tidied(with_inputs([*EVENTS, "review_events"], f"""
    SELECT e.seq, e.session_id AS analysis_id, a.field_id, e.outcome, f.field_name, f.instrument_label AS label, f.decision,
           CASE WHEN e.outcome IN ('accept_after_edit', 'missing_label') THEN a.entered ELSE f.value END AS final_value,
           CASE WHEN e.outcome IN ('accept_after_edit', 'missing_label') THEN coalesce(f.value, '空') || ' → ' || a.entered END AS edit_description,
           coalesce(e.profile, 'default') AS profile, greatest(0.0::DOUBLE, e.elapsed_s) AS elapsed_s
    FROM review_events e
    JOIN (SELECT event_id AS seq, {A._case_sql('event_type', _ACTION_FIELD)} AS field_id, props AS entered FROM events) a USING (seq)
    LEFT JOIN form f ON f.clip_id = e.session_id AND f.field_id = a.field_id""", **_FORM_PARTS), "elapsed_s"))
def recorded_query(spark, d):
    """Reviewers' actions joined to the form fields they were shown."""
    actions = A.review_events(spark, d).select(
        F.col("session_id").alias("analysis_id"), "seq", "outcome", F.coalesce("profile", F.lit("default")).alias("profile"),
        F.lit(0.0).alias("shown_s"), F.col("elapsed_s").alias("acted_s"),
    )
    entered = A.table(spark, d, "events").select(
        F.col("event_id").alias("seq"), A._case(F.col("event_type"), _ACTION_FIELD).alias("field_id"), F.col("props").alias("entered")
    )
    fields = expand_form(form_inputs(spark, d)).withColumnRenamed("clip_id", "analysis_id")
    return tidy(record_events(actions.join(entered, "seq"), fields))


@register("form_summary", tidied(with_inputs(EVENTS, """
    SELECT *, confirmed / total AS confirmed_coverage, (confirmed + candidate) / total AS prefill_coverage
    FROM (SELECT clip_id, count_if(decision = 'confirmed')::BIGINT AS confirmed, count_if(decision = 'candidate')::BIGINT AS candidate,
                 count_if(decision = 'unknown')::BIGINT AS unknown, count(*) AS total FROM form GROUP BY clip_id)""", **_FORM_PARTS),
    "confirmed_coverage", "prefill_coverage"))
def form_summary_query(spark, d):
    return tidy(form_summary(expand_form(form_inputs(spark, d))))
