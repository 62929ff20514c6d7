"""Window bounds: overlapping windows over a clip and the fixed cadence of a scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from earmark import constants as C
from earmark.functions.columns import half_even_samples


def sliding_windows(clips: DataFrame, window_s: float, hop_s: float) -> DataFrame:
    """Overlapping windows per clip; a short last one is kept, and the first to reach the end is last.

    ``clips``: clip_id, n_samples, sample_rate. The number of windows is arithmetic, so a clip
    becomes rows by ``explode(sequence)`` without any loop or shuffle.
    """
    if window_s <= 0 or hop_s <= 0:
        raise ValueError("window and hop must be positive")
    n, rate = F.col("n_samples"), F.col("sample_rate")
    size, hop = half_even_samples(window_s, rate), half_even_samples(hop_s, rate)
    reaching = F.greatest(F.lit(0), F.ceil((n - size) / hop)) + 1
    count = F.least(reaching, F.ceil(n / hop)).cast("int")
    start = F.col("window_idx") * F.col("_hop")
    return (
        clips.filter(n > 0)
        .withColumn("_size", size)
        .withColumn("_hop", hop)
        .withColumn("window_idx", F.explode(F.sequence(F.lit(0), count - 1)))
        .select(
            "clip_id",
            "window_idx",
            (start / rate).alias("start_s"),
            (F.least(start + F.col("_size"), n) / rate).alias("end_s"),
        )
    )


def cadence_bounds(windows: DataFrame, sample_rate: int, index: str = "window_idx") -> DataFrame:
    """Start and end of windows that a scorer emits at its own cadence.

    ``windows`` needs the window number ``index`` and the clip's ``duration_s``.
    """
    start = F.col(index) * F.lit(C.CADENCE_HOP_SAMPLES / sample_rate)
    end = F.least(F.col("duration_s"), start + F.lit(C.CADENCE_PATCH_SAMPLES / sample_rate))
    return windows.withColumn("start_s", start).withColumn("end_s", end)
