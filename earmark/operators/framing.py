"""Overlapping frames over a sample table, by arithmetic instead of a join."""

from __future__ import annotations

from collections.abc import Mapping
from math import gcd

from pyspark.sql import Column, DataFrame, functions as F

SLICE_ROWS = 65_536


def frame_sizes(rate: int, frame_s: float, hop_s: float) -> tuple[int, int]:
    """Frame and hop in samples, half-even, at least one."""
    return max(1, round(frame_s * rate)), max(1, round(hop_s * rate))


def frames_of(index: Column, size: int, hop: int) -> Column:
    """The numbers of all frames that contain position ``index``."""
    first = F.greatest(F.lit(0), F.ceil((index - (size - 1)) / F.lit(hop)))
    last = F.floor(index / F.lit(hop))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def assign_frames(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """One row per (sample, frame it lies in), partial frames at the end included."""
    return samples.withColumn("frame", F.explode(frames_of(F.col("i"), size, hop)))


def frame_table(
    samples: DataFrame,
    size: int,
    hop: int,
    *,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Sums and maxima per (clip, full frame); a signal shorter than a frame gives one short frame.

    Samples are first reduced to blocks of gcd(size, hop) and only the blocks are repeated per
    frame, so overlap multiplies block rows, never samples. A frame is full when it counts
    ``size`` samples; frame 0 always stays.
    """
    block = gcd(size, hop)
    sums, maxima = dict(sums or {}), dict(maxima or {})
    blocks = samples.groupBy("clip_id", F.floor(F.col("i") / block).alias("_block")).agg(
        F.count("*").alias("n"),
        *[F.sum(e).alias(name) for name, e in sums.items()],
        *[F.max(e).alias(name) for name, e in maxima.items()],
    )
    numbered = blocks.withColumn(
        "frame", F.explode(frames_of(F.col("_block"), size // block, hop // block))
    )
    return (
        numbered.groupBy("clip_id", "frame")
        .agg(
            F.sum("n").alias("n"),
            *[F.sum(name).alias(name) for name in sums],
            *[F.max(name).alias(name) for name in maxima],
        )
        .filter((F.col("n") == size) | (F.col("frame") == 0))
    )


def frame_counts(samples: DataFrame, hop: int) -> DataFrame:
    """(clip_id, _n): at least as many frames as a clip has, from its last sample; a frame starts every ``hop`` samples."""
    return samples.groupBy("clip_id").agg((F.floor(F.max("i") / F.lit(hop)) + 1).alias("_n"))


def frame_slice() -> Column:
    return F.floor(F.col("frame") / SLICE_ROWS)
