"""Quality gates and signal descriptors over sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark import constants as C
from earmark.operators.framing import assign_frames, frame_table
from earmark.operators.quality import (
    clip_warnings,
    note_rows,
    quality_gate,
    result_warnings,
    shape_channels,
)
from earmark.operators.spatial import classify_spatial, pan_track, stereo_moments
from earmark.operators.timbre import (
    classify_timbre,
    envelope_features,
    spectral_features,
    zero_crossing_rate,
)
from earmark.plans import adapters as A
from earmark.plans.adapters import SIGNAL_RATE, with_inputs
from earmark.plans.catalog.registry import register, tidied, tidy
from earmark.plans.catalog.scores import EVENTS, events_decisions, score_parts

# envelope frames at the stand-in rate of 100 samples per second
ENVELOPE = {"size": 20, "hop": 10}

_VALUES = "SELECT clip_id, i, unnest(ch) AS x FROM channel_samples"
_MEASURED = """
    SELECT clip_id, count(DISTINCT i) AS n_samples, sqrt(sum(x * x) / count(x)) AS rms,
           bool_or(isnan(x) OR isinf(x)) AS not_finite, avg((abs(x) >= 0.999::DOUBLE AND NOT isnan(x))::INT) AS clipped
    FROM channel_values GROUP BY clip_id"""
_CHANNELS = {"channel_values": _VALUES, "measured": _MEASURED}


@register("quality_gate", tidied(with_inputs(["clips", "channel_samples"], """
    SELECT clip_id, coalesce(n_samples, 0) / sample_rate AS duration_s, CASE WHEN isnan(rms) THEN NULL ELSE rms END AS rms,
           CASE WHEN lower(suffix) NOT IN ('.wav', '.mp3', '.flac', '.m4a', '.aac', '.ogg') THEN 'unsupported_suffix'
                WHEN sample_rate < 1000 OR sample_rate > 384000 THEN 'abnormal_sample_rate'
                WHEN n_samples IS NULL THEN 'empty' WHEN not_finite THEN 'not_finite'
                WHEN n_samples / sample_rate > 600 THEN 'too_long' WHEN rms < 1e-5::DOUBLE THEN 'silent' END AS reason
    FROM clips LEFT JOIN measured USING (clip_id)""", **_CHANNELS), "duration_s", "rms"))
def quality_gate_query(spark, d):
    gate = quality_gate(A.clips(spark, d), A.channel_samples(spark, d))
    return tidy(gate.withColumn("rms", F.when(~F.isnan("rms"), F.col("rms"))))


_NOTES = """
    SELECT clip_id, unnest(list_filter([CASE WHEN channels = 1 THEN 'source_is_mono' END,
               CASE WHEN channels > 2 THEN 'multichannel_downmixed_to_first_two_channels' END,
               CASE WHEN coalesce(clipped, 0) > 0.01::DOUBLE THEN 'severe_clipping_detected' END], lambda x: x IS NOT NULL)) AS warning
    FROM clips LEFT JOIN measured USING (clip_id)"""


@register("clip_warnings", with_inputs(["clips", "channel_samples"], _NOTES, **_CHANNELS))
def clip_warnings_query(spark, d):
    return note_rows(clip_warnings(A.clips(spark, d), A.channel_samples(spark, d))).drop("position")


@register("shape_channels", tidied(with_inputs(["channel_samples"], """
    SELECT clip_id, i, CASE WHEN isnan(mono) THEN NULL ELSE mono END AS mono, CASE WHEN isnan(l) THEN NULL ELSE l END AS l,
           CASE WHEN isnan(r) THEN NULL ELSE r END AS r
    FROM (SELECT clip_id, i, list_sum(ch) / len(ch) AS mono, ch[1] AS l, CASE WHEN len(ch) > 1 THEN ch[2] ELSE ch[1] END AS r
          FROM channel_samples)"""), "mono", "l", "r"))
def shape_channels_query(spark, d):
    shaped = shape_channels(A.channel_samples(spark, d))
    return tidy(shaped.select("clip_id", "i", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("mono", "l", "r")]))


_MOMENTS = """
    SELECT clip_id, rms, NOT heard AS low_energy, CASE WHEN heard THEN (re - le) / (re + le + 1e-12::DOUBLE) END AS pan_value,
           CASE WHEN heard THEN se / (me + 1e-12::DOUBLE) END AS width_ratio,
           CASE WHEN heard THEN CASE WHEN ls > 1e-12::DOUBLE AND rs > 1e-12::DOUBLE THEN lr ELSE 1.0::DOUBLE END END AS correlation
    FROM (SELECT *, sqrt((le + re) / 2) AS rms, sqrt((le + re) / 2) >= 1e-4::DOUBLE AS heard
          FROM (SELECT clip_id, avg(l * l) AS le, avg(r * r) AS re, avg((l + r) * (l + r) / 4) AS me, avg((l - r) * (l - r) / 4) AS se,
                       stddev_pop(l) AS ls, stddev_pop(r) AS rs, corr(l, r) AS lr FROM stereo_samples GROUP BY clip_id))"""
_FRAMES = """
    SELECT clip_id, frame, count(*) AS n, sum(l * l) / count(*) AS le, sum(r * r) / count(*) AS re
    FROM (SELECT *, i // 5 - k AS frame FROM stereo_samples, (VALUES (0), (1)) AS t(k))
    WHERE frame >= 0 GROUP BY clip_id, frame HAVING count(*) = 10 OR frame = 0"""
_TRACK = """
    SELECT clip_id, quantile_cont(pan, 0.75) - quantile_cont(pan, 0.25) AS pan_iqr, coalesce(avg(abs(pan - before)), 0.0::DOUBLE) AS movement_rate
    FROM (SELECT *, lag(pan) OVER (PARTITION BY clip_id ORDER BY frame) AS before
          FROM (SELECT clip_id, frame, (re - le) / (re + le + 1e-12::DOUBLE) AS pan FROM frames WHERE sqrt((le + re) / 2) >= 1e-4::DOUBLE))
    GROUP BY clip_id"""


@register("stereo_moments", tidied(with_inputs(["stereo_samples"], _MOMENTS), "rms", "pan_value", "width_ratio", "correlation"))
def stereo_moments_query(spark, d):
    return tidy(stereo_moments(A.stereo_samples(spark, d)))


@register("assign_frames", with_inputs(["stereo_samples"], """
    SELECT clip_id, i // 5 - k AS frame, count(*) AS n, min(i) AS first_i, max(i) AS last_i
    FROM stereo_samples, (VALUES (0), (1)) AS t(k) WHERE i // 5 - k >= 0 GROUP BY ALL"""))
def assign_frames_query(spark, d):
    framed = assign_frames(A.stereo_samples(spark, d).select("clip_id", "i"), 10, 5)
    return framed.groupBy("clip_id", "frame").agg(
        F.count("*").alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i")
    )


@register("frame_energies", tidied(with_inputs(["stereo_samples"], "SELECT clip_id, frame, n, le, re FROM frames", frames=_FRAMES), "le", "re"))
def frame_energies_query(spark, d):
    samples = A.stereo_samples(spark, d)
    frames = frame_table(samples, 10, 5, sums={"ls": F.col("l") * F.col("l"), "rs": F.col("r") * F.col("r")})
    return tidy(frames.select("clip_id", "frame", "n", (F.col("ls") / F.col("n")).alias("le"), (F.col("rs") / F.col("n")).alias("re")))


@register("pan_track", tidied(with_inputs(["stereo_samples"], "SELECT * FROM track", frames=_FRAMES, track=_TRACK), "pan_iqr", "movement_rate"))
def pan_track_query(spark, d):
    return tidy(pan_track(A.stereo_samples(spark, d), SIGNAL_RATE))


_SPATIAL = """
    SELECT clip_id, pan_value, width_ratio, correlation,
           CASE WHEN low_energy OR channels = 1 THEN 'unknown' WHEN iqr >= 0.25::DOUBLE THEN 'moving' WHEN abs(pan_value) <= 0.15::DOUBLE THEN 'center'
                WHEN pan_value > 0 THEN 'right' ELSE 'left' END AS pan,
           CASE WHEN low_energy THEN 'unknown' WHEN channels = 1 OR width_ratio <= 0.02::DOUBLE THEN 'mono' WHEN width_ratio <= 0.18::DOUBLE THEN 'narrow'
                WHEN width_ratio <= 0.6::DOUBLE THEN 'medium' ELSE 'wide' END AS width,
           CASE WHEN low_energy THEN 'unknown' WHEN iqr >= 0.25::DOUBLE THEN 'variable' ELSE 'stable' END AS stability,
           CASE WHEN NOT low_energy THEN iqr END AS pan_iqr,
           CASE WHEN low_energy THEN 'low_energy' WHEN channels = 1 THEN 'mono_source' ELSE 'global_mix' END AS basis,
           CASE WHEN low_energy THEN 'spatial_low_energy' WHEN correlation < -0.2::DOUBLE THEN 'possible_phase_inversion' ELSE '' END AS warnings
    FROM (SELECT m.*, c.channels, coalesce(t.pan_iqr, 0.0::DOUBLE) AS iqr
          FROM moments m LEFT JOIN track t USING (clip_id) JOIN clips c USING (clip_id))"""


def _spatial(spark, d):
    samples = A.stereo_samples(spark, d)
    return classify_spatial(stereo_moments(samples), pan_track(samples, SIGNAL_RATE), A.clips(spark, d))


@register("classify_spatial", tidied(with_inputs(["stereo_samples", "clips"], _SPATIAL, moments=_MOMENTS, frames=_FRAMES, track=_TRACK), "pan_value", "width_ratio", "correlation", "pan_iqr"))
def classify_spatial_query(spark, d):
    result = _spatial(spark, d).withColumn("warnings", F.concat_ws("|", "warnings"))
    return tidy(result.drop("movement_rate"))


_NOTES_LIST = """
    SELECT clip_id, list_filter([CASE WHEN channels = 1 THEN 'source_is_mono' END,
               CASE WHEN channels > 2 THEN 'multichannel_downmixed_to_first_two_channels' END,
               CASE WHEN coalesce(clipped, 0) > 0.01::DOUBLE THEN 'severe_clipping_detected' END], lambda x: x IS NOT NULL) AS own
    FROM clips LEFT JOIN measured USING (clip_id)"""


@register("result_warnings", with_inputs(["clips", "channel_samples", "stereo_samples", *EVENTS], """
    SELECT n.clip_id, list_aggregate(list_concat(n.own, CASE WHEN coalesce(s.warnings, '') <> '' THEN [s.warnings] ELSE [] END,
               CASE WHEN coalesce(f.confirmed, false) THEN ['confirmed_results_require_human_review'] ELSE [] END,
               ['per_instrument_timbre_requires_reliable_stems']), 'string_agg', '|') AS warnings
    FROM notes n LEFT JOIN spatial s USING (clip_id)
    LEFT JOIN (SELECT clip_id, bool_or(decision = 'confirmed') AS confirmed FROM decided GROUP BY clip_id) f USING (clip_id)""",
    **_CHANNELS, notes=_NOTES_LIST, moments=_MOMENTS, frames=_FRAMES, track=_TRACK, spatial=_SPATIAL, **score_parts("frame_scores")))
def result_warnings_query(spark, d):
    notes = clip_warnings(A.clips(spark, d), A.channel_samples(spark, d))
    decisions = events_decisions(spark, d).select(
        "clip_id", "decision", F.lit(False).alias("has_timbre")
    )
    found = result_warnings(notes, _spatial(spark, d), decisions)
    return found.withColumn("warnings", F.concat_ws("|", "warnings"))


_MONO = "SELECT clip_id, i, (l + r) / 2 AS x FROM stereo_samples"
_ENVELOPE_FRAMES = """
    SELECT clip_id, frame, sqrt(sum(x * x) / count(*)) AS rms, max(abs(x)) AS peak
    FROM (SELECT *, i // 10 - k AS frame FROM mono, (VALUES (0), (1)) AS t(k))
    WHERE frame >= 0 GROUP BY clip_id, frame HAVING count(*) = 20 OR frame = 0"""
_STEPS = """
    SELECT *, peak / (rms + 1e-12::DOUBLE) AS crest, greatest(0.0::DOUBLE, rms - coalesce(lag(rms) OVER w, rms)) AS rise,
           max(rms) OVER (PARTITION BY clip_id) AS loudest,
           first(frame) OVER (PARTITION BY clip_id ORDER BY rms DESC, frame) AS peak_at
    FROM envelope WINDOW w AS (PARTITION BY clip_id ORDER BY frame)"""
_ENVELOPE = """
    SELECT clip_id, crest_factor, onset_strength,
           CASE WHEN n > 2 AND loudest > 0 THEN (coalesce(faded_at, n) - peak_at) * 10 / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS temporal_decay_s,
           CASE WHEN n_active >= 2 THEN 20 * log10((loud + 1e-12::DOUBLE) / (quiet + 1e-12::DOUBLE)) ELSE 0.0::DOUBLE END AS dynamic_range_db
    FROM (SELECT clip_id, count(*) AS n, any_value(loudest) AS loudest, any_value(peak_at) AS peak_at,
                 quantile_cont(crest, 0.5) AS crest_factor, quantile_cont(rise, 0.9) AS onset_strength,
                 min(frame) FILTER (frame >= peak_at AND rms <= loudest * 0.37::DOUBLE) AS faded_at,
                 count(*) FILTER (rms > greatest(1e-5::DOUBLE, loudest * 0.1::DOUBLE)) AS n_active,
                 quantile_cont(rms, 0.95) FILTER (rms > greatest(1e-5::DOUBLE, loudest * 0.1::DOUBLE)) AS loud,
                 quantile_cont(rms, 0.10) FILTER (rms > greatest(1e-5::DOUBLE, loudest * 0.1::DOUBLE)) AS quiet
          FROM steps GROUP BY clip_id)"""
_ENVELOPE_PARTS = {"mono": _MONO, "envelope": _ENVELOPE_FRAMES, "steps": _STEPS, "envelope_stats": _ENVELOPE}
_ENVELOPE_DOUBLES = ("crest_factor", "onset_strength", "temporal_decay_s", "dynamic_range_db")


def _mono(spark, d):
    return A.stereo_samples(spark, d).select("clip_id", "i", ((F.col("l") + F.col("r")) / 2).alias("mono"))


@register("envelope_features", tidied(with_inputs(["stereo_samples"], "SELECT * FROM envelope_stats", **_ENVELOPE_PARTS), *_ENVELOPE_DOUBLES))
def envelope_query(spark, d):
    return tidy(envelope_features(_mono(spark, d), SIGNAL_RATE, **ENVELOPE))


@register("zero_crossing_rate", tidied(with_inputs(["stereo_samples"], """
    SELECT clip_id, avg((negative <> before)::INT) AS zero_crossing_rate
    FROM (SELECT clip_id, x < 0 AS negative, lag(x < 0) OVER (PARTITION BY clip_id ORDER BY i) AS before FROM mono) GROUP BY clip_id""",
    mono=_MONO), "zero_crossing_rate"))
def zero_crossing_query(spark, d):
    return tidy(zero_crossing_rate(_mono(spark, d)))


_SPECTRAL = """
    SELECT clip_id, quantile_cont(centroid, 0.5) AS spectral_centroid_hz, quantile_cont(rolloff, 0.5) AS spectral_rolloff_hz,
           quantile_cont(high_share, 0.5) AS high_frequency_energy_ratio, quantile_cont(flatness, 0.5) AS spectral_flatness
    FROM (SELECT clip_id, frame, sum(freq_hz * p) / (sum(p) + 1e-12::DOUBLE) AS centroid, min(freq_hz) FILTER (cum >= 0.85::DOUBLE * total) AS rolloff,
                 sum(CASE WHEN freq_hz >= 4000 THEN p ELSE 0 END) / (sum(p) + 1e-12::DOUBLE) AS high_share,
                 exp(avg(ln(magnitude))) / avg(magnitude) AS flatness
          FROM (SELECT *, sum(p) OVER (PARTITION BY clip_id, frame ORDER BY freq_hz ROWS UNBOUNDED PRECEDING) AS cum,
                       sum(p) OVER (PARTITION BY clip_id, frame) AS total
                FROM (SELECT *, magnitude * magnitude AS p FROM spectrum))
          GROUP BY clip_id, frame)
    GROUP BY clip_id"""
_SPECTRAL_DOUBLES = ("spectral_centroid_hz", "spectral_rolloff_hz", "high_frequency_energy_ratio", "spectral_flatness")


@register("spectral_features", tidied(with_inputs(["spectrum"], _SPECTRAL), *_SPECTRAL_DOUBLES))
def spectral_query(spark, d):
    return tidy(spectral_features(A.spectrum(spark, d)))


def _vote_sql(value: str, bounds: tuple[float, float], labels: tuple[str, str, str]) -> str:
    low, high = bounds
    return (f"CASE WHEN {value} < {low}::DOUBLE THEN '{labels[0]}' WHEN {value} > {high}::DOUBLE THEN '{labels[2]}' "
            f"ELSE '{labels[1]}' END")


def _timbre_sql() -> str:
    """One SELECT per label with norms, plus one without."""
    selects = []
    for label in ("drums", "bass", "piano", "strings"):
        norm = C.TIMBRE_NORMS[label]
        light = ("dark", "neutral", "bright")
        bite = ("soft", "neutral", "sharp")
        b1, b2 = _vote_sql("spectral_centroid_hz", norm["centroid_hz"], light), _vote_sql("high_frequency_energy_ratio", norm["hf_ratio"], light)
        a1, a2 = _vote_sql("crest_factor", norm["crest_factor"], bite), _vote_sql("onset_strength", norm["onset_strength"], bite)
        held = _vote_sql("temporal_decay_s", norm["decay_seconds"], ("short", "medium", "long"))
        selects.append(f"""
            SELECT clip_id, '{label}' AS canonical_label, CASE WHEN {b1} = {b2} THEN {b1} ELSE 'neutral' END AS brightness,
                   CASE WHEN {b1} = {b2} THEN 'confirmed' ELSE 'candidate' END AS brightness_decision, CASE WHEN {b1} = {b2} THEN 2 ELSE 1 END AS brightness_support,
                   CASE WHEN {a1} = {a2} THEN {a1} ELSE 'neutral' END AS attack,
                   CASE WHEN {a1} = {a2} THEN 'confirmed' ELSE 'candidate' END AS attack_decision, CASE WHEN {a1} = {a2} THEN 2 ELSE 1 END AS attack_support,
                   {held} AS sustain, 'candidate' AS sustain_decision, 1 AS sustain_support FROM features""")
    selects.append("""
            SELECT clip_id, 'woodwind' AS canonical_label, 'unknown' AS brightness, 'unknown' AS brightness_decision, 0 AS brightness_support,
                   'unknown' AS attack, 'unknown' AS attack_decision, 0 AS attack_support,
                   'unknown' AS sustain, 'unknown' AS sustain_decision, 0 AS sustain_support FROM features""")
    return " UNION ALL ".join(selects)


@register("classify_timbre", with_inputs(["stereo_samples", "spectrum"], _timbre_sql(), **_ENVELOPE_PARTS, spectral=_SPECTRAL,
    features="SELECT * FROM envelope_stats JOIN spectral USING (clip_id)"))
def classify_timbre_query(spark, d):
    envelope = envelope_features(_mono(spark, d), SIGNAL_RATE, **ENVELOPE)
    features = envelope.join(spectral_features(A.spectrum(spark, d)), "clip_id")
    labels = F.array(*map(F.lit, ("drums", "bass", "piano", "strings", "woodwind")))
    return classify_timbre(features.withColumn("canonical_label", F.explode(labels)))
