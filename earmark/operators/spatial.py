"""Stereo image of a clip: moments, pan track over frames, and classes.

Samples: clip_id, i, l, r.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from earmark import constants as C
from earmark.functions.ordered import MAX_GROUP_ROWS, order_statistics, ordered_changes
from earmark.operators.framing import frame_counts, frame_sizes, frame_slice, frame_table


def stereo_moments(samples: DataFrame) -> DataFrame:
    """Pan value, width ratio and correlation per clip; null numbers below the energy floor.

    All inputs are mergeable sums, so one pass with map-side combining serves clips of any size.
    """
    l, r = F.col("l").cast("double"), F.col("r").cast("double")
    mid, side = (l + r) / 2, (l - r) / 2
    sums = samples.groupBy("clip_id").agg(
        F.avg(l * l).alias("le"),
        F.avg(r * r).alias("re"),
        F.avg(mid * mid).alias("me"),
        F.avg(side * side).alias("se"),
        F.stddev_pop(l).alias("ls"),
        F.stddev_pop(r).alias("rs"),
        F.covar_pop(l, r).alias("lr"),
    )
    le, re = F.col("le"), F.col("re")
    rms = F.sqrt((le + re) / 2)
    heard = rms >= C.SILENCE_RMS
    varied = (F.col("ls") > C.EPSILON) & (F.col("rs") > C.EPSILON)
    return sums.select(
        "clip_id",
        rms.alias("rms"),
        (~heard).alias("low_energy"),
        F.when(heard, (re - le) / (re + le + C.EPSILON)).alias("pan_value"),
        F.when(heard, F.col("se") / (F.col("me") + C.EPSILON)).alias("width_ratio"),
        F.when(heard, F.when(varied, F.col("lr") / (F.col("ls") * F.col("rs"))).otherwise(1.0)).alias("correlation"),
    )


def frame_pans(samples: DataFrame, rate: int) -> DataFrame:
    """Pan value of every frame above the silence floor."""
    size, hop = frame_sizes(rate, C.FRAME_SECONDS, C.HOP_SECONDS)
    l, r = F.col("l").cast("double"), F.col("r").cast("double")
    frames = frame_table(samples, size, hop, sums={"ls": l * l, "rs": r * r})
    le, re = F.col("ls") / F.col("n"), F.col("rs") / F.col("n")
    return frames.filter(F.sqrt((le + re) / 2) >= C.SILENCE_RMS).select(
        "clip_id", "frame", ((re - le) / (re + le + C.EPSILON)).alias("pan")
    )


def pan_track(samples: DataFrame, rate: int, *, limit: int = MAX_GROUP_ROWS) -> DataFrame:
    """Spread (IQR) of frame pans and their mean change between consecutive retained frames.

    Clips without an audible frame do not appear; read their values as 0.
    """
    _, hop = frame_sizes(rate, C.FRAME_SECONDS, C.HOP_SECONDS)
    pans = frame_pans(samples, rate)
    spread = order_statistics(
        pans, ["clip_id"], {"p75": ("pan", 0.75), "p25": ("pan", 0.25)},
        limit=limit, sizes=frame_counts(samples, hop),
    )
    moves = ordered_changes(
        pans, ["clip_id"], "frame", "pan", lambda a, b: F.abs(b - a),
        slice_of=frame_slice(), total="moved", pairs="pairs",
    )
    return spread.join(moves, "clip_id").select(
        "clip_id",
        (F.col("p75") - F.col("p25")).alias("pan_iqr"),
        F.when(F.col("pairs") > 0, F.col("moved") / F.col("pairs")).otherwise(0.0).alias("movement_rate"),
    )


def classify_spatial(moments: DataFrame, track: DataFrame, clips: DataFrame) -> DataFrame:
    """Pan, width and stability classes with basis and warnings. ``clips``: clip_id, channels."""
    joined = moments.join(track, "clip_id", "left").join(clips.select("clip_id", "channels"), "clip_id")
    quiet, mono = F.col("low_energy"), F.col("channels") == 1
    iqr = F.coalesce(F.col("pan_iqr"), F.lit(0.0))
    moving = iqr >= C.MOVING_IQR_MIN
    pan, width = F.col("pan_value"), F.col("width_ratio")
    return joined.select(
        "clip_id",
        F.when(quiet | mono, "unknown")
        .when(moving, "moving")
        .when(F.abs(pan) <= C.CENTER_ABS_MAX, "center")
        .when(pan > 0, "right")
        .otherwise("left")
        .alias("pan"),
        "pan_value",
        F.when(quiet, "unknown")
        .when(mono | (width <= C.MONO_MAX), "mono")
        .when(width <= C.NARROW_MAX, "narrow")
        .when(width <= C.MEDIUM_MAX, "medium")
        .otherwise("wide")
        .alias("width"),
        "width_ratio",
        "correlation",
        F.when(quiet, "unknown").when(moving, "variable").otherwise("stable").alias("stability"),
        F.when(~quiet, iqr).alias("pan_iqr"),
        F.when(~quiet, F.coalesce(F.col("movement_rate"), F.lit(0.0))).alias("movement_rate"),
        F.when(quiet, "low_energy").when(mono, "mono_source").otherwise("global_mix").alias("basis"),
        F.array_compact(
            F.array(
                F.when(quiet, "spatial_low_energy"),
                F.when(~quiet & (F.col("correlation") < C.PHASE_CORRELATION), "possible_phase_inversion"),
            )
        ).alias("warnings"),
    )


def analyse_spatial(samples: DataFrame, clips: DataFrame, rate: int) -> DataFrame:
    """Moments, pan track and classes together."""
    return classify_spatial(stereo_moments(samples), pan_track(samples, rate), clips)
