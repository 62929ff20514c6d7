"""Stereo image, envelope, spectrum and quality gates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark.operators.quality import clip_warnings, quality_gate, shape_channels
from earmark.operators.spatial import analyse_spatial, frame_pans, pan_track
from earmark.operators.timbre import (
    classify_timbre,
    envelope_features,
    spectral_features,
    zero_crossing_rate,
)

RATE = 4410


def tones(spark, clips, seconds=1.0):
    """Stereo sine tones: {clip: (left gain, right gain)}, gains may be functions of time."""
    rows = spark.range(int(RATE * seconds)).select(F.col("id").alias("i"), (F.col("id") / F.lit(RATE)).alias("t"))
    parts = None
    for clip, gains in clips.items():
        wave = 0.2 * F.sin(2 * math.pi * 440 * F.col("t"))
        left, right = [g(F.col("t")) if callable(g) else F.lit(float(g)) for g in gains]
        part = rows.select(F.lit(clip).alias("clip_id"), "i", (wave * left).alias("l"), (wave * right).alias("r"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def channels(spark, clips):
    return spark.createDataFrame(list(clips.items()), "clip_id string, channels int")


def test_pan_width_and_phase(spark):
    gains = {"left": (1, 0.1), "right": (0.1, 1), "center": (1, 1), "narrow": (1, 0.6), "wide": (1, -0.25),
             "inverted": (1, -1), "mono": (1, 1), "silent": (0, 0)}
    samples = tones(spark, gains)
    counts = {clip: 1 if clip == "mono" else 2 for clip in gains}
    got = {r.clip_id: r for r in analyse_spatial(samples, channels(spark, counts), RATE).collect()}
    assert [got[c].pan for c in ("left", "right", "center")] == ["left", "right", "center"]
    assert (got["center"].width, got["narrow"].width, got["wide"].width) == ("mono", "narrow", "wide")
    assert got["inverted"].warnings == ["possible_phase_inversion"] and got["inverted"].correlation < -0.99
    assert (got["mono"].pan, got["mono"].width, got["mono"].basis) == ("unknown", "mono", "mono_source")
    silent = got["silent"]
    assert (silent.basis, silent.pan_value, silent.pan_iqr, silent.warnings) == ("low_energy", None, None, ["spatial_low_energy"])


def test_moving_pan(spark):
    place = lambda t: F.sin(2 * math.pi * t / 1.5)
    samples = tones(spark, {"m": (lambda t: 1 - place(t), lambda t: 1 + place(t))}, seconds=2.0)
    row = analyse_spatial(samples, channels(spark, {"m": 2}), RATE).first()
    assert (row.pan, row.stability) == ("moving", "variable")


@pytest.mark.parametrize("n", [1, 7, 10, 14, 15, 23, 60])
def test_pan_track_equals_a_loop(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 2))
    x[(np.arange(n) // 12) % 2 == 1] = 0.0
    df = spark.createDataFrame([("c", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "clip_id string, i long, l double, r double")
    pans = []
    for start in range(0, max(1, n - 10 + 1), 5):
        le, re = (x[start:start + 10] ** 2).mean(axis=0)
        if math.sqrt((le + re) / 2) >= 1e-4:
            pans.append((re - le) / (re + le + 1e-12))
    got = [r.pan for r in frame_pans(df, 100).orderBy("frame").collect()]
    assert got == pytest.approx(pans)
    for limit in (1000, 1):
        row = pan_track(df, 100, limit=limit).first()
        assert row.pan_iqr == pytest.approx(np.percentile(pans, 75) - np.percentile(pans, 25))
        assert row.movement_rate == pytest.approx(np.abs(np.diff(pans)).mean() if len(pans) > 1 else 0.0)


def test_envelope_equals_numpy(spark):
    rng = np.random.default_rng(1)
    clips = {k: rng.normal(size=n) * np.exp(-np.arange(n) / 60) for k, n in enumerate((5, 30, 200))}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in clips.items() for i, v in enumerate(x)], "clip_id int, i long, mono double")
    expected = {}
    for k, x in clips.items():
        frames = [x[s:s + 20] for s in range(0, max(1, len(x) - 20 + 1), 10)]
        rms = np.array([np.sqrt((f**2).mean()) for f in frames])
        peak = np.array([np.abs(f).max() for f in frames])
        active = rms[rms > max(1e-5, rms.max() * 0.1)]
        decay = 0.0
        if len(rms) > 2:
            after = rms[rms.argmax():]
            below = np.flatnonzero(after <= rms.max() * 0.37)
            decay = (below[0] if below.size else len(after)) * 10 / 100
        expected[k] = (
            np.median(peak / (rms + 1e-12)),
            np.percentile(np.maximum(0, np.diff(rms, prepend=rms[0])), 90),
            decay,
            20 * np.log10((np.percentile(active, 95) + 1e-12) / (np.percentile(active, 10) + 1e-12)) if active.size >= 2 else 0.0,
        )
    for limit in (1000, 1):
        got = envelope_features(df, 100, size=20, hop=10, limit=limit).collect()
        assert len(got) == 3
        for r in got:
            assert (r.crest_factor, r.onset_strength, r.temporal_decay_s, r.dynamic_range_db) == pytest.approx(expected[r.clip_id])
    zcr = {r.clip_id: r.zero_crossing_rate for r in zero_crossing_rate(df).collect()}
    for k, x in clips.items():
        assert zcr[k] == pytest.approx(np.abs(np.diff(np.signbit(x).astype(int))).mean())


def test_spectrum_and_classes(spark):
    rng = np.random.default_rng(2)
    mags = rng.random((4, 65)) + 1e-12
    freq = np.arange(65) * 125.0
    df = spark.createDataFrame([("c", f, float(freq[b]), float(mags[f, b])) for f in range(4) for b in range(65)],
                               "clip_id string, frame int, freq_hz double, magnitude double")
    row = spectral_features(df).first()
    p = mags**2
    cum = p.cumsum(axis=1)
    assert row.spectral_centroid_hz == pytest.approx(np.median((freq * p).sum(1) / (p.sum(1) + 1e-12)))
    assert row.spectral_rolloff_hz == pytest.approx(np.median(freq[(cum >= 0.85 * cum[:, -1:]).argmax(1)]))
    assert row.high_frequency_energy_ratio == pytest.approx(np.median(p[:, freq >= 4000].sum(1) / (p.sum(1) + 1e-12)))
    assert row.spectral_flatness == pytest.approx(np.median(np.exp(np.log(mags).mean(1)) / mags.mean(1)))
    features = [("c", "drums", 1000.0, 0.01, 5.0, 0.3, 0.1), ("c", "woodwind", 1000.0, 0.01, 5.0, 0.3, 0.1)]
    table = spark.createDataFrame(features, "clip_id string, canonical_label string, spectral_centroid_hz double, "
                                  "high_frequency_energy_ratio double, crest_factor double, onset_strength double, temporal_decay_s double")
    got = {r.canonical_label: r for r in classify_timbre(table).collect()}
    drums = got["drums"]
    assert (drums.brightness, drums.brightness_decision, drums.brightness_support) == ("dark", "confirmed", 2)
    assert (drums.attack, drums.attack_decision, drums.attack_support) == ("neutral", "candidate", 1)
    assert drums.sustain == "short"
    assert (got["woodwind"].brightness, got["woodwind"].attack, got["woodwind"].sustain_support) == ("unknown", "unknown", 0)


def test_gate_and_warnings(spark):
    clips = spark.createDataFrame(
        [("ok", ".WAV", 16000, 2), ("txt", ".txt", 16000, 1), ("slow", ".wav", 999, 1), ("none", ".wav", 16000, 1),
         ("nan", ".wav", 16000, 1), ("long", ".wav", 1000, 1), ("quiet", ".mp3", 16000, 3)],
        "clip_id string, suffix string, sample_rate int, channels int")
    data = [("ok", i, [1.0, 0.5]) for i in range(10)] + [("txt", 0, [1.0]), ("slow", 0, [1.0]), ("nan", 0, [float("nan")])]
    data += [("quiet", i, [0.0, 0.0, 0.0]) for i in range(1000)]
    samples = spark.createDataFrame(data, "clip_id string, i int, ch array<double>").unionByName(
        spark.range(600_001).select(F.lit("long").alias("clip_id"), F.col("id").cast("int").alias("i"), F.array(F.lit(0.5)).alias("ch")))
    got = {r.clip_id: r.reason for r in quality_gate(clips, samples).collect()}
    assert got == {"ok": None, "txt": "unsupported_suffix", "slow": "abnormal_sample_rate", "none": "empty",
                   "nan": "not_finite", "long": "too_long", "quiet": "silent"}
    notes = {r.clip_id: r.warnings for r in clip_warnings(clips, samples).collect()}
    assert notes["ok"] == ["severe_clipping_detected"] and notes["nan"] == ["source_is_mono"]
    assert notes["quiet"] == ["multichannel_downmixed_to_first_two_channels"]


def test_channel_shapes(spark):
    df = spark.createDataFrame([("a", 0, [0.2]), ("a", 1, [0.2, 0.4]), ("a", 2, [0.3, 0.6, 0.9])], "clip_id string, i int, ch array<double>")
    got = [tuple(round(v, 6) for v in (r.mono, r.l, r.r)) for r in shape_channels(df).orderBy("i").collect()]
    assert got == [(0.2, 0.2, 0.2), (0.3, 0.2, 0.4), (0.6, 0.3, 0.6)]


@pytest.mark.parametrize("limit", [1000, 1])
def test_silent_clip_has_no_active_frames(spark, limit):
    df = spark.range(100).select(F.lit("z").alias("clip_id"), F.col("id").alias("i"), F.lit(0.0).alias("mono"))
    row = envelope_features(df, 100, size=20, hop=10, limit=limit).first()
    assert (row.onset_strength, row.temporal_decay_s, row.dynamic_range_db) == (0.0, 0.0, 0.0)
    assert zero_crossing_rate(df).first().zero_crossing_rate == 0.0
