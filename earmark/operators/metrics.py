"""Binary metrics, average precision and three-way decision coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from earmark import constants as C
from earmark.functions.columns import f1_score, ratio
from earmark.functions.ordered import running_totals
from earmark.operators.decisions import decision
from earmark.operators.quality import judged, sound


def binary_metrics(
    preds: DataFrame, keys: Sequence[str], *, tie_break: Sequence[str] | None = None
) -> DataFrame:
    """Metrics per key at the ``threshold`` column of each row (constant within a key).

    With ``tie_break`` the average precision is added as ``pr_auc``, from the same pass over the ranked rows.
    Scores are clipped to [0, 1]; a row with a target other than 0 or 1 or a score that is not finite fails the
    job (set such rows aside with ``validate_scores`` first).
    """
    hit, true = F.col("score") >= F.col("threshold"), F.col("target") == 1
    rows, rated = judged(preds), []
    if tie_break is not None:
        rows, rated = _ranked(rows, keys, tie_break, ["threshold"]), [_precision_sum()]
    counts = rows.groupBy(*keys).agg(
        F.max("_fault").alias("_fault"),
        F.max("threshold").alias("threshold"),
        F.count("*").alias("samples"),
        F.count_if(true).alias("positives"),
        F.count_if(~true).alias("negatives"),
        F.count_if(hit).alias("predicted_positive"),
        F.count_if(hit & true).alias("true_positive"),
        F.count_if(hit & ~true).alias("false_positive"),
        F.count_if(~hit & true).alias("false_negative"),
        *rated,
    )
    return sound(counts).select(
        *[c for c in counts.columns if c not in ("_fault", "pr_auc")],
        ratio(F.col("true_positive"), F.col("predicted_positive")).alias("precision"),
        ratio(F.col("true_positive"), F.col("positives")).alias("recall"),
        ratio(F.col("predicted_positive"), F.col("samples")).alias("coverage"),
        *(["pr_auc"] if rated else []),
    ).withColumn("f1", f1_score(F.col("precision"), F.col("recall")))


def _ranked(judged_rows: DataFrame, keys: Sequence[str], tie_break: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Rows with ``rank`` and ``hits`` (positives up to here) along falling scores, ties by ``tie_break``.

    Rows are dealt into parts of equal size along that order, so a label, or one score that a third of all
    rows share, is ranked by many tasks.
    """
    columns = list(dict.fromkeys([*keys, "score", "target", "_fault", *tie_break, *more]))
    rows = judged_rows.select(*columns, F.lit(1).cast("long").alias("_n"), F.col("target").cast("long").alias("_tp"))
    totals = running_totals(rows, keys, "score", ["_n", "_tp"], descending=True, then=tie_break)
    return totals.select(*columns, (F.col("_n_before") + 1).alias("rank"), (F.col("_tp_before") + F.col("_tp")).alias("hits"))


def _precision_sum() -> Column:
    """Mean of the precisions at the ranks of the positives, 0.0 without positives."""
    gain = F.sum(F.when(F.col("target") == 1, F.col("hits") / F.col("rank")))
    positives = F.sum(F.col("target").cast("long"))
    return F.when(positives > 0, gain / positives).otherwise(0.0).alias("pr_auc")


def average_precision(preds: DataFrame, keys: Sequence[str], tie_break: Sequence[str]) -> DataFrame:
    """Non-interpolated average precision; equal scores are ranked by ``tie_break``, a total order."""
    ranked = _ranked(judged(preds), keys, tie_break)
    return sound(ranked.groupBy(*keys).agg(_precision_sum(), F.max("_fault").alias("_fault")))


def decision_counts(preds: DataFrame) -> list[Column]:
    """Mergeable counts of the three decisions; ``preds`` needs the threshold columns."""
    made = decision(F.col("score"), F.col("candidate"), F.col("confirmed"), F.col("auto_confirm"))
    true = F.col("target") == 1
    return [
        F.count("*").alias("samples"),
        F.count_if(true).alias("positives"),
        F.count_if(made == C.CONFIRMED).alias("confirmed_count"),
        F.count_if(made == C.CANDIDATE).alias("candidate_count"),
        F.count_if(made == C.UNKNOWN).alias("unknown_count"),
        F.count_if((made == C.CONFIRMED) & true).alias("confirmed_true_positive"),
        F.count_if((made == C.CANDIDATE) & true).alias("candidate_true_positive"),
    ]


def decision_ratios(counts: DataFrame) -> DataFrame:
    """Coverages and precisions from decision counts, 0.0 on empty denominators."""
    n = F.col("samples")
    prefilled = F.col("confirmed_count") + F.col("candidate_count")
    return counts.select(
        "*",
        ratio(F.col("confirmed_count"), n).alias("confirmed_coverage"),
        ratio(F.col("candidate_count"), n).alias("candidate_coverage"),
        ratio(prefilled, n).alias("prefill_coverage"),
        ratio(F.col("unknown_count"), n).alias("unknown_coverage"),
        ratio(F.col("confirmed_true_positive"), F.col("confirmed_count")).alias("confirmed_precision"),
        ratio(F.col("candidate_true_positive"), F.col("candidate_count")).alias("candidate_precision"),
    )


def decision_coverage(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mutually exclusive confirmed / candidate / unknown counts, coverages and precisions."""
    rows = judged(preds)
    return decision_ratios(sound(rows.groupBy(*keys).agg(*decision_counts(rows), F.max("_fault").alias("_fault"))))
