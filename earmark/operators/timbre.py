"""Envelope and spectral features of a clip, and classes by per-label norms.

Mono samples: clip_id, i, mono. Spectrum: clip_id, frame, freq_hz, magnitude.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from earmark import constants as C
from earmark.functions.ordered import (
    MAX_GROUP_ROWS,
    order_statistics,
    ordered_changes,
    previous_value,
    with_key_totals,
)
from earmark.operators.framing import SLICE_ROWS, frame_counts, frame_slice, frame_table
from earmark.sources.dims import norms_dim

TINY = 1e-12


def envelope_frames(rate: int) -> tuple[int, int]:
    """Frame and hop of the envelope in samples (50 ms, half overlapped, with floors)."""
    size = max(256, round(rate * 0.05))
    return size, max(128, size // 2)


def envelope_features(
    mono: DataFrame, rate: int, *, size: int | None = None, hop: int | None = None, limit: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Crest factor, onset strength, temporal decay and dynamic range per clip."""
    default_size, default_hop = envelope_frames(rate)
    size, hop = size or default_size, hop or default_hop
    x = F.col("mono").cast("double")
    frames = frame_table(mono, size, hop, sums={"square": x * x}, maxima={"peak": F.abs(x)}).select(
        "clip_id", "frame", F.sqrt(F.col("square") / F.col("n")).alias("rms"), "peak"
    )
    stepped = previous_value(frames, ["clip_id"], "frame", "rms", "_before", SLICE_ROWS)
    # the loudest frame, the earliest one on ties
    placed = with_key_totals(
        stepped, ["clip_id"], frame_slice(),
        {"_loudest": F.struct(F.col("rms").alias("rms"), (-F.col("frame")).alias("at"))},
    ).select(
        "*", F.col("_loudest.rms").alias("_max"), (-F.col("_loudest.at")).alias("_peak_at")
    )
    rms = F.col("rms")
    active = rms > F.greatest(F.lit(1e-5), F.col("_max") * 0.1)
    faded = (F.col("frame") >= F.col("_peak_at")) & (rms <= F.col("_max") * 0.37)
    measured = placed.select(
        "clip_id",
        "frame",
        "_max",
        "_peak_at",
        (F.col("peak") / (rms + TINY)).alias("crest"),
        F.greatest(F.lit(0.0), rms - F.coalesce("_before", "rms")).alias("rise"),
        F.when(active, rms).alias("active_rms"),
        F.when(faded, F.col("frame")).alias("faded_at"),
    )
    stats = order_statistics(
        measured,
        ["clip_id"],
        {
            "crest_factor": ("crest", 0.5),
            "onset_strength": ("rise", 0.9),
            "loud": ("active_rms", 0.95),
            "quiet": ("active_rms", 0.10),
        },
        aggregates={
            "n_frames": F.count("*"),
            "n_active": F.count("active_rms"),
            "max_rms": F.max("_max"),
            "peak_at": F.max("_peak_at"),
            "faded_at": F.min("faded_at"),
        },
        limit=limit,
        sizes=frame_counts(mono, hop),
    )
    tail = F.coalesce(F.col("faded_at"), F.col("n_frames")) - F.col("peak_at")
    span = 20 * F.log10((F.col("loud") + TINY) / (F.col("quiet") + TINY))
    return stats.select(
        "clip_id",
        "crest_factor",
        "onset_strength",
        F.when((F.col("n_frames") > 2) & (F.col("max_rms") > 0), tail * F.lit(hop) / F.lit(rate))
        .otherwise(0.0)
        .alias("temporal_decay_s"),
        F.when(F.col("n_active") >= 2, span).otherwise(0.0).alias("dynamic_range_db"),
    )


def zero_crossing_rate(mono: DataFrame) -> DataFrame:
    """Share of consecutive samples whose sign differs; -0.0 counts as not negative."""
    signs = mono.select("clip_id", "i", (F.col("mono") < 0).alias("negative"))
    changes = ordered_changes(
        signs, ["clip_id"], "i", "negative", lambda a, b: (a != b).cast("int"),
        slice_of=F.floor(F.col("i") / SLICE_ROWS), total="changed", pairs="pairs",
    )
    return changes.select(
        "clip_id", F.when(F.col("pairs") > 0, F.col("changed") / F.col("pairs")).alias("zero_crossing_rate")
    )


def spectral_frames(spectrum: DataFrame) -> DataFrame:
    """Centroid, roll-off, high-frequency share and flatness per frame.

    A window holds one frame, whose number of bins is fixed by the transform.
    """
    m, freq = F.col("magnitude").cast("double"), F.col("freq_hz")
    power = m * m
    frame = Window.partitionBy("clip_id", "frame")
    running = frame.orderBy("freq_hz").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = frame.orderBy("freq_hz").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = spectrum.select("clip_id", "frame", freq.alias("freq_hz"), m.alias("magnitude"), power.alias("power"))
    placed = placed.withColumn("_cum", F.sum("power").over(running)).withColumn(
        "_all", F.last("_cum").over(every)
    )
    total = F.sum("power") + TINY
    reached = F.when(F.col("_cum") >= C.ROLLOFF_SHARE * F.col("_all"), F.col("freq_hz"))
    high = F.when(F.col("freq_hz") >= C.HIGH_FREQUENCY_HZ, F.col("power")).otherwise(0.0)
    return placed.groupBy("clip_id", "frame").agg(
        (F.sum(F.col("freq_hz") * F.col("power")) / total).alias("centroid"),
        F.min(reached).alias("rolloff"),
        (F.sum(high) / total).alias("high_share"),
        (F.exp(F.avg(F.ln("magnitude"))) / F.avg("magnitude")).alias("flatness"),
    )


def spectral_features(
    spectrum: DataFrame, *, limit: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Medians over frames of the spectral summaries."""
    frames = spectrum.select("clip_id", "frame").distinct()  # each frame once, however many bins it has
    sizes = frames.groupBy("clip_id").agg(F.count("*").alias("_n"))
    return order_statistics(
        spectral_frames(spectrum),
        ["clip_id"],
        {
            "spectral_centroid_hz": ("centroid", 0.5),
            "spectral_rolloff_hz": ("rolloff", 0.5),
            "high_frequency_energy_ratio": ("high_share", 0.5),
            "spectral_flatness": ("flatness", 0.5),
        },
        limit=limit,
        sizes=sizes,
    )


def _vote(value: Column, norm: str, labels: tuple[str, str, str]) -> Column:
    low, inside, high = labels
    return (
        F.when(value < F.col(f"{norm}_lo"), low).when(value > F.col(f"{norm}_hi"), high).otherwise(inside)
    )


def classify_timbre(features: DataFrame, norms: Mapping | None = None) -> DataFrame:
    """Brightness, attack and sustain by the norms of the label; no norms means unknown.

    Two indicators vote on brightness and on attack: agreement confirms, disagreement leaves the
    middle class as candidate. ``features``: clip_id, canonical_label and the feature columns.
    """
    known = F.col("centroid_hz_lo").isNotNull()
    joined = features.join(F.broadcast(norms_dim(features.sparkSession, norms)), "canonical_label", "left")
    pairs = {
        "brightness": (
            ("spectral_centroid_hz", "centroid_hz"),
            ("high_frequency_energy_ratio", "hf_ratio"),
            ("dark", "neutral", "bright"),
        ),
        "attack": (
            ("crest_factor", "crest_factor"),
            ("onset_strength", "onset_strength"),
            ("soft", "neutral", "sharp"),
        ),
    }
    columns: list[Column] = []
    for name, ((value_a, norm_a), (value_b, norm_b), labels) in pairs.items():
        a, b = _vote(F.col(value_a), norm_a, labels), _vote(F.col(value_b), norm_b, labels)
        agreed = a == b
        columns += [
            F.when(~known, "unknown").when(agreed, a).otherwise(labels[1]).alias(name),
            F.when(~known, C.UNKNOWN).when(agreed, C.CONFIRMED).otherwise(C.CANDIDATE).alias(f"{name}_decision"),
            F.when(~known, 0).when(agreed, 2).otherwise(1).alias(f"{name}_support"),
        ]
    sustain = _vote(F.col("temporal_decay_s"), "decay_seconds", ("short", "medium", "long"))
    columns += [
        F.when(known, sustain).otherwise("unknown").alias("sustain"),
        F.when(known, C.CANDIDATE).otherwise(C.UNKNOWN).alias("sustain_decision"),
        F.when(known, 1).otherwise(0).alias("sustain_support"),
    ]
    return joined.select("clip_id", "canonical_label", *columns)
