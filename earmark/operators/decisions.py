"""Three-way decisions, ambiguity between exclusive labels, and the release class."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from earmark import constants as C
from earmark.sources.dims import label_dim


def decision(score: Column, candidate: Column, confirmed: Column, auto: Column) -> Column:
    """Confirmed is tested first: its threshold may lie below the candidate one."""
    return (
        F.when(auto & (score >= confirmed), C.CONFIRMED)
        .when(score >= candidate, C.CANDIDATE)
        .otherwise(C.UNKNOWN)
    )


def decide(presence: DataFrame) -> DataFrame:
    """Decision from the presence score and the label's thresholds."""
    return presence.withColumn(
        "decision",
        decision(F.col("score"), F.col("candidate"), F.col("confirmed"), F.col("auto_confirm")),
    )


def demote_ambiguous(
    decisions: DataFrame, *, taxonomy: Mapping | None = None, margin: float = C.SUBTYPE_MARGIN
) -> DataFrame:
    """Where the two best labels of an exclusive group are closer than ``margin``, confirmed
    members become candidates. A window holds at most the labels of one group of one clip."""
    groups = label_dim(decisions.sparkSession, taxonomy).select("canonical_label", "exclusive_group")
    group = Window.partitionBy("clip_id", "exclusive_group")
    ranked = (
        decisions.join(F.broadcast(groups), "canonical_label", "left")
        .withColumn("_rank", F.row_number().over(group.orderBy(F.col("score").desc(), "canonical_label")))
    )
    first = F.max(F.when(F.col("_rank") == 1, F.col("score"))).over(group)
    second = F.max(F.when(F.col("_rank") == 2, F.col("score"))).over(group)
    close = F.col("exclusive_group").isNotNull() & (first - second < margin)
    softened = F.when(
        F.coalesce(close, F.lit(False)) & (F.col("decision") == C.CONFIRMED), C.CANDIDATE
    ).otherwise(F.col("decision"))
    return ranked.withColumn("decision", softened).select(*decisions.columns)


def product_class(summary: DataFrame) -> DataFrame:
    """Release class and gate flags; class A needs human evidence that no table holds."""
    precision, prefill = F.col("confirmed_precision"), F.col("prefill_coverage")
    return summary.select(
        F.when(precision < C.RELEASE_PRECISION, "C").otherwise("B").alias("product_class"),
        (precision >= C.RELEASE_PRECISION).alias("precision_passed"),
        (prefill >= C.RELEASE_PREFILL).alias("prefill_passed"),
    )
