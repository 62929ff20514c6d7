"""Fusion, forms, review analytics and incremental operators."""

import pytest
from pyspark.sql import functions as F

from earmark import constants as C
from earmark.operators.decisions import product_class
from earmark.operators.forms import expand_form, form_summary
from earmark.operators.fusion import energy_ratios, fuse, fuse_for_comparison
from earmark.operators.incremental import dedupe_submissions, fold_task_patches, split_cached, task_key
from earmark.operators.quality import result_warnings
from earmark.operators.review import effective_values, outcome_pivot, review_rates, time_savings, validate_review_events
from earmark.operators.scoring import apply_scorer

PROFILE = "calibrated_public_v1"
MIX = "clip_id string, canonical_label string, decision string, score double, pan string, width string, stability string, basis string"


def mix_row(label, score, decision="unknown", clip="c"):
    return (clip, label, decision, score, "unknown", "unknown", "unknown", C.NO_STEM_BASIS)


def test_stems_lift_only_supported_labels_and_never_confirm(spark):
    mix = spark.createDataFrame([mix_row("drums", 0.1), mix_row("electric_guitar", 0.1), mix_row("voice", 0.2, "confirmed"),
                                 mix_row("bass", 0.1)], MIX)
    stems = spark.createDataFrame(
        [("c", "drums", "drums", 0.9), ("c", "drums", "electric_guitar", 0.2), ("c", "other", "drums", 0.2),
         ("c", "other", "electric_guitar", 0.99), ("c", "bass", "bass", 0.9)],
        "clip_id string, stem string, canonical_label string, score double")
    energy = spark.createDataFrame([("c", "drums", 0.5), ("c", "other", 0.495), ("c", "bass", 0.005)], "clip_id string, stem string, energy double")
    spatial = spark.createDataFrame([("c", "drums", "left", "narrow", "stable", "separator:drums"), ("c", "bass", "left", "narrow", "stable", "separator:bass")],
                                    "clip_id string, stem string, pan string, width string, stability string, basis string")
    got = {r.canonical_label: r for r in fuse(mix, stems, energy, spatial, PROFILE).collect()}
    assert (got["drums"].decision, got["drums"].fused_score, got["drums"].pan) == ("candidate", 0.9, "left")
    assert got["electric_guitar"].decision == "unknown" and got["electric_guitar"].fused_score == 0.1
    assert got["electric_guitar"].warnings == ["other_stem_not_used_for_instrument_identity"]
    assert got["bass"].warnings == ["supported_stem_energy_too_low"] and got["bass"].basis == C.NO_STEM_BASIS
    assert got["bass"].fused_score == pytest.approx(max(0.1, 0.9 * 0.005 / 0.08))
    assert got["voice"].decision == "confirmed" and got["voice"].stem_scores is None
    assert got["drums"].stem_scores == {"drums": 0.9, "other": 0.2}
    compared = fuse_for_comparison(mix.select("clip_id", "canonical_label", F.col("score").alias("mix_score")), stems, energy)
    assert {r.canonical_label: r.fused_score for r in compared.collect()}["drums"] == 0.9


def test_energy_shares(spark):
    df = spark.createDataFrame([("c", "a", 1.0, 1.0), ("c", "b", 3.0, 3.0), ("z", "a", 0.0, 0.0)], "clip_id string, stem string, l double, r double")
    got = {(r.clip_id, r.stem): r.energy for r in energy_ratios(df).collect()}
    assert got == {("c", "a"): 0.25, ("c", "b"): 0.75, ("z", "a"): 0.0}


def form_rows(spark, rows):
    return spark.createDataFrame([(*r, t) for r, t in rows], MIX + ", timbre string")


def test_mix_image_never_reaches_a_label(spark):
    row = ("c", "piano", "confirmed", 0.9, "left", "wide", "moving", C.NO_STEM_BASIS)
    fields = {r.field_id: r for r in expand_form(form_rows(spark, [(row, None)])).collect()}
    assert len(fields) == 10
    assert fields["piano.instrument_name"].decision == "confirmed" and not fields["piano.instrument_name"].requires_review
    assert fields["piano.pan"].decision == "unknown" and fields["piano.pan"].value is None and "禁止" in fields["piano.pan"].reason
    assert fields["global.instrument_count"].value == "1" and fields["global.instrument_count"].requires_review


def test_form_with_stem_timbre_and_nothing_detected(spark):
    rows = [(("a", "bass", "candidate", 0.5, "left", "unknown", "stable", "separator:bass"), '{"brightness":"dark"}'),
            (mix_row("piano", 0.1, clip="a"), None), (mix_row("piano", 0.1, clip="b"), None)]
    fields = expand_form(form_rows(spark, rows))
    got = {(r.clip_id, r.field_id): r for r in fields.collect()}
    assert got["a", "bass.pan"].value == "left" and got["a", "bass.pan"].source == "instrument.spatial:separator:bass"
    assert got["a", "bass.width"].value is None and got["a", "bass.width"].decision == "unknown"
    assert got["a", "bass.timbre"].value.startswith("{") and got["a", "bass.movement"].value == "stable"
    assert got["b", "global.instrument_count"].value is None and got["b", "global.instrument_count"].decision == "unknown"
    summary = {r.clip_id: r for r in form_summary(fields).collect()}
    assert (summary["a"].total, summary["a"].candidate, summary["b"].total) == (11, 5, 2)
    assert summary["b"].prefill_coverage == 0.0


def test_warnings_of_a_result(spark):
    notes = spark.createDataFrame([("a", ["source_is_mono"]), ("b", [])], "clip_id string, warnings array<string>")
    spatial = spark.createDataFrame([("a", ["possible_phase_inversion"])], "clip_id string, warnings array<string>")
    decisions = spark.createDataFrame([("a", "confirmed", False), ("b", "candidate", True)], "clip_id string, decision string, has_timbre boolean")
    got = {r.clip_id: r.warnings for r in result_warnings(notes, spatial, decisions).collect()}
    assert got["a"] == ["source_is_mono", "possible_phase_inversion", "confirmed_results_require_human_review",
                        "per_instrument_timbre_requires_reliable_stems"]
    assert got["b"] == []


def test_release_class(spark):
    df = spark.createDataFrame([(0.95, 0.39), (0.5, 0.9)], "confirmed_precision double, prefill_coverage double")
    assert [tuple(r) for r in product_class(df).collect()] == [("B", True, False), ("C", False, True)]


EVENTS = "field_id string, field_name string, label string, decision string, outcome string, elapsed_s double, profile string"


def test_review_rates_and_pivots(spark):
    rows = [("bass.instrument_name", "instrument_name", "bass", "confirmed", "accept_as_is", 2.5, "default"),
            ("x", "pan", "bass", "confirmed", "reject", 1.0, "default"),
            ("human_labels.harp", None, None, None, "missing_label", 1.0, "default")]
    df = spark.createDataFrame(rows, EVENTS)
    row = review_rates(df).first()
    assert (row.confirmed_accept_rate, row.candidate_accept_rate, row.wrong_confirmed_rate) == (0.5, None, 0.5)
    assert row.missing_rate == pytest.approx(1 / 3) and row.prefill_rate == pytest.approx(2 / 3)
    by_label = {r.label: r for r in outcome_pivot(df, "label").collect()}
    assert by_label["bass"].reject == 1 and by_label["global"].missing_label == 1 and by_label["bass"].uncertain == 0
    assert {r.field for r in outcome_pivot(df, "field").collect()} == {"instrument_name", "pan", "human_labels.harp"}


def test_bad_events_are_named(spark):
    rows = [("a", None, None, None, "reject", 0.0, "p"), ("b", None, None, None, "reject", -1.0, "p"),
            ("c", None, None, None, "maybe", 1.0, "p"), ("d", None, None, None, "reject", 1.0, None)]
    good, bad = validate_review_events(spark.createDataFrame(rows, EVENTS))
    assert [r.field_id for r in good.collect()] == ["a"]
    assert {r.field_id: r.reason for r in bad.collect()} == {"b": "negative_elapsed", "c": "unknown_outcome", "d": "profile_missing"}


def test_time_savings_ignore_missing_baselines(spark):
    rows = [(8.0, 20.0, 1.2), (5.0, None, 1.0), (5.0, 0.0, 1.0), (15.0, 20.0, 2.0)]
    for limit in (100, 2):
        row = time_savings(spark.createDataFrame(rows, "total_review_s double, baseline_s double, model_s double"), limit=limit).first()
        assert row.mean_saving == pytest.approx((0.6 + 0.25) / 2) and row.median_saving == pytest.approx(0.425)
        assert (row.n_sessions, row.n_timed, row.median_review_s) == (4, 2, 6.5)


def test_overrides_do_not_change_predictions(spark):
    preds = spark.createDataFrame([("a", "instruments.0.decision", "candidate"), ("a", "x", "y")], "analysis_id string, field_path string, value string")
    log = spark.createDataFrame([("a", 1, "instruments.0.decision", "removed"), ("a", 2, "instruments.0.decision", "confirmed")],
                                "analysis_id string, seq int, field_path string, new_value string")
    got = {r.field_path: r for r in effective_values(preds, log).collect()}
    row = got["instruments.0.decision"]
    assert (row.value, row.effective_value, row.n_overrides) == ("candidate", "confirmed", 2)
    assert got["x"].effective_value == "y"


def test_dedupe(spark):
    subs = spark.createDataFrame([(1, "s1", "p", False), (2, "s1", "p", False), (3, "s1", "p", True), (4, "s2", "p", False)],
                                 "seq int, sha string, profile string, separation boolean")
    known = subs.filter("seq = 4").select(task_key(F.col("sha"), F.col("profile"), F.col("separation")).alias("task_id"))
    got = {r.seq: r.status for r in dedupe_submissions(subs, known).collect()}
    assert got == {1: "queued", 2: "cached", 3: "queued", 4: "cached"}


def test_patch_fold_keeps_last_known_values(spark):
    rows = [("a", 1, "queued", 0.0, None, None), ("a", 2, "running", 0.5, None, "sha"), ("a", 3, "failed", 1.0, "boom", None), ("a", 4, "done", 1.0, None, None)]
    row = fold_task_patches(spark.createDataFrame(rows, "analysis_id string, seq int, status string, progress double, error string, file_sha256 string")).first()
    assert (row.status, row.error, row.file_sha256) == ("done", "boom", "sha")


def test_cache_counts_only_complete_samples(spark):
    required = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "sample_id string, label string")
    cache = spark.createDataFrame([("a", "x", 0.1), ("b", "x", 0.2)], "sample_id string, label string, score double")
    cached, todo = split_cached(required, cache)
    assert [tuple(r) for r in cached.collect()] == [("b", "x", 0.2)]
    assert sorted(map(tuple, todo.collect())) == [("a", "x"), ("a", "y")]


def test_scorer_shape_is_checked(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id int, embedding array<double>")
    got = {r.id: r.scores for r in apply_scorer(df, lambda: lambda x: x * 2, ["p", "q"], keep=["id"]).collect()}
    assert got == {1: [2.0, 4.0], 2: [6.0, 8.0]}
    with pytest.raises(Exception, match="scorer returned shape"):
        apply_scorer(df, lambda: lambda x: x[:, :1], ["p", "q"], keep=["id"]).collect()


@pytest.mark.parametrize("limit", [100, 1])
def test_no_baseline_gives_no_saving(spark, limit):
    rows = [(8.0, None, 1.2), (6.0, 0.0, 1.2)]
    row = time_savings(spark.createDataFrame(rows, "total_review_s double, baseline_s double, model_s double"), limit=limit).first()
    assert (row.n_timed, row.mean_saving, row.median_saving, row.median_review_s) == (0, None, None, 7.0)
    empty = spark.createDataFrame([], "total_review_s double, baseline_s double, model_s double")
    assert time_savings(empty).first().n_sessions == 0
