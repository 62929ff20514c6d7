"""Quota sampling for evaluation sets, with leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from earmark.functions.columns import literal_table

def seeded_order(key: str, seed: int) -> Column:
    """A reproducible shuffle: order by the digest of key and seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def quota_sample(
    pool: DataFrame, quota: int, order: Sequence[Column | str], *, key: str = "sample_id"
) -> DataFrame:
    """First ``quota`` records of every (label, target) in the given order.

    A record may be drawn for several labels, and only those count as judged. The rank limit
    lets each task drop all but ``quota`` rows per group before the shuffle.
    """
    ranked = pool.filter(F.col("target").isNotNull()).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("label", "target").orderBy(*order, key))
    )
    return ranked.filter(F.col("_rank") <= quota).drop("_rank")


def quota_shortfalls(
    chosen: DataFrame, labels: Sequence[str], quota: int, *, tolerate_positive: bool = False
) -> DataFrame:
    """(label, target) pairs that stayed below the quota; with tolerance a positive pair with at
    least one record passes."""
    cells = literal_table(
        chosen.sparkSession, "label string, target boolean", [(x, t) for x in labels for t in (True, False)]
    )
    counted = chosen.groupBy("label", "target").agg(F.count("*").alias("drawn"))
    short = cells.join(counted, ["label", "target"], "left").fillna(0, subset=["drawn"]).filter(
        F.col("drawn") < quota
    )
    return short.filter(~(F.col("target") & (F.col("drawn") >= 1))) if tolerate_positive else short


def require_quota(chosen: DataFrame, labels: Sequence[str], quota: int, **options) -> DataFrame:
    """``chosen`` itself, or an error naming the pairs that lack records."""
    missing = [f"{r.label}={r.target}" for r in quota_shortfalls(chosen, labels, quota, **options).collect()]
    if missing:
        raise RuntimeError(f"not enough records for {', '.join(sorted(missing))}")
    return chosen


def second_split(
    pool: DataFrame,
    taken: DataFrame,
    quota: int,
    order: Sequence[Column | str],
    *,
    key: str = "sample_id",
) -> DataFrame:
    """Quota sample from the records the first split did not take."""
    used = taken.select(key).distinct()  # Spark chooses the join by the size it finds
    return quota_sample(pool.join(used, key, "left_anti"), quota, order, key=key)


def greedy_partial_sample(
    pool: DataFrame,
    quota: int,
    order: Sequence[Column | str],
    *,
    key: str = "sample_id",
) -> DataFrame:
    """Scan in order, take a record if it helps any unfilled (label, target); all its judgments count.

    Equivalent without a scan: while a pair has fewer than ``quota`` judgments every record judged
    for it is taken, so its first ``quota`` records are; and a record outside the first ``quota``
    of all its pairs finds every counter full. So keep records with any rank <= quota.
    """
    first = quota_sample(pool, quota, order, key=key).select(key).distinct()
    return pool.filter(F.col("target").isNotNull()).join(first, key, "left_semi")


def leaking_groups(samples: DataFrame) -> DataFrame:
    """Groups present in both the calibration and the evaluation split."""
    return (
        samples.groupBy("group_id")
        .agg(
            F.count_if(F.col("split") == "calibration").alias("calibration_rows"),
            F.count_if(F.col("split") == "evaluation").alias("evaluation_rows"),
        )
        .filter((F.col("calibration_rows") > 0) & (F.col("evaluation_rows") > 0))
    )


def assert_no_leak(samples: DataFrame) -> DataFrame:
    if not leaking_groups(samples).isEmpty():
        raise RuntimeError("a source group appears in both splits")
    return samples


def late_fetch(chosen: DataFrame, wide: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Payload columns of the chosen rows only.

    Choosing reads narrow columns; the payload scan is a second one that keeps matching keys.
    """
    return wide.select(key, *columns).join(chosen.select(key).distinct(), key, "left_semi")
