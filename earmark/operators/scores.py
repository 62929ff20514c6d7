"""Score statistics per clip and label, and the presence score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from earmark import constants as C
from earmark.functions.ordered import MAX_GROUP_ROWS, order_statistics
from earmark.sources.dims import with_profile

KEYS = ("clip_id", "canonical_label")


def score_statistics(
    canonical: DataFrame,
    profile: str,
    *,
    keys: Sequence[str] = KEYS,
    limit: int = MAX_GROUP_ROWS,
    known_small: bool = False,
    last_window: bool = False,
) -> DataFrame:
    """Mean, median, max, p90, p95, top-20 % mean and active ratio, with the label's thresholds.

    ``last_window`` adds the latest window as a struct (start_s, window_idx, end_s).
    """
    leveled = with_profile(canonical, profile)
    active = F.when(F.col("score") >= F.col("candidate"), 1.0).otherwise(0.0)
    return order_statistics(
        leveled,
        keys,
        {"median": ("score", 0.5), "p90": ("score", 0.9), "p95": ("score", 0.95)},
        top_means={"top_mean": ("score", C.TOP_FRACTION)},
        aggregates={
            "mean": F.avg("score"),
            "max": F.max("score"),
            "active_ratio": F.avg(active),
            "candidate": F.max("candidate"),
            "confirmed": F.max("confirmed"),
            "auto_confirm": F.max("auto_confirm"),
            **({"last_window": F.max(F.struct("start_s", "window_idx", "end_s"))} if last_window else {}),
        },
        limit=limit,
        known_small=known_small,
    )


def top_fraction_mean(
    df: DataFrame,
    keys: Sequence[str],
    *,
    value: str = "score",
    fraction: float = C.TOP_FRACTION,
    name: str = "top_mean",
    limit: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Mean of the largest ``max(1, ceil(n * fraction))`` values per key."""
    return order_statistics(df, keys, {}, top_means={name: (value, fraction)}, limit=limit)


def presence_score(stats: DataFrame) -> DataFrame:
    """0.65 x top-20 % mean + 0.35 x p95 as ``score``."""
    weighted = F.lit(C.TOP_WEIGHT) * F.col("top_mean") + F.lit(C.P95_WEIGHT) * F.col("p95")
    return stats.withColumn("score", weighted)
