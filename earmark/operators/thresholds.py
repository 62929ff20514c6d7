"""Threshold search over score histograms: O(n log n), and never a whole label in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from earmark import constants as C
from earmark.functions.columns import f1_score, ratio
from earmark.functions.ordered import join_on, running_totals
from earmark.operators.quality import applicable, judged, sound


def score_histogram(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (n) and positives (tp) per key and distinct clipped score, combined before the shuffle; ``_fault`` says
    why a row is unusable."""
    return judged(preds).groupBy(*keys, "score").agg(
        F.count("*").alias("n"), F.sum(F.col("target").cast("long")).alias("tp"), F.max("_fault").alias("_fault")
    )


def _at_thresholds(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every distinct score as threshold, with what would be predicted at it."""
    below = running_totals(hist, keys, "score", ["n", "tp"], descending=True)
    return below.select(
        *keys,
        F.col("score").alias("threshold"),
        (F.col("n_before") + F.col("n")).alias("predicted"),
        (F.col("tp_before") + F.col("tp")).alias("hits"),
        F.col("n_total").alias("samples"),
        F.col("tp_total").alias("positives"),
        *[c for c in hist.columns if c == "_fault"],
    )


def search_threshold(
    preds: DataFrame,
    keys: Sequence[str],
    *,
    precision_target: float = C.PRECISION_TARGET,
    minimum_positives: int = C.MINIMUM_VALIDATION_POSITIVES,
) -> DataFrame:
    """Threshold of largest coverage among those meeting the precision target.

    Coverage grows strictly as the threshold falls, so the choice is the lowest qualified score.
    No qualified score gives threshold 1.0 and zeros. Scores are clipped to [0, 1]; an unusable row
    fails the job (set such rows aside with ``validate_scores`` first).
    """
    rows = _at_thresholds(score_histogram(preds, keys), keys)
    qualified = F.col("hits") / F.col("predicted") >= precision_target
    best = rows.groupBy(*keys).agg(
        F.min(F.when(qualified, F.struct("threshold", "predicted", "hits"))).alias("best"),
        F.max("samples").alias("samples"),
        F.max("positives").alias("positives"),
        F.max("_fault").alias("_fault"),
    )
    predicted = F.coalesce(F.col("best.predicted"), F.lit(0))
    hits = F.coalesce(F.col("best.hits"), F.lit(0))
    met = F.col("best").isNotNull()
    rated = sound(best).select(
        *keys,
        F.coalesce(F.col("best.threshold"), F.lit(1.0)).alias("threshold"),
        ratio(hits, predicted).alias("precision"),
        ratio(hits, F.col("positives")).alias("recall"),
        ratio(predicted, F.col("samples")).alias("coverage"),
        predicted.alias("predicted_positive"),
        F.col("positives").alias("validation_positives"),
        met.alias("meets_precision_target"),
        (met & (F.col("positives") >= minimum_positives)).alias("auto_confirm"),
    )
    return rated.withColumn("f1", f1_score(F.col("precision"), F.col("recall")))


def calibrate_two(
    preds: DataFrame,
    keys: Sequence[str],
    *,
    precision_target: float = C.PRECISION_TARGET,
    recall_target: float = C.RECALL_TARGET,
    minimum_positives: int = C.MINIMUM_VALIDATION_POSITIVES,
) -> DataFrame:
    """Candidate and confirmed thresholds by a second rule.

    0.0 and 1.0 are always tried. An empty prediction counts as precision 1.0 here, so the
    confirmed threshold can be a useless 1.0 with auto confirmation on; that is kept.
    """
    given = preds.select(
        *keys, "score", F.lit(1).cast("long").alias("n"), F.col("target").cast("long").alias("tp")
    )
    ends = (
        preds.select(*keys)
        .distinct()
        .select(*keys, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("score"))
        .withColumn("n", F.lit(0).cast("long"))
        .withColumn("tp", F.lit(0).cast("long"))
    )
    hist = given.unionByName(ends).groupBy(*keys, "score").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(1.0)
    rows = _at_thresholds(hist, keys).select(
        "*", precision.alias("precision"), ratio(F.col("hits"), F.col("positives")).alias("recall")
    )
    rows = rows.withColumn("f1", f1_score(F.col("precision"), F.col("recall")))
    by_f1 = F.struct("f1", -F.col("threshold"))
    good = F.col("precision") >= precision_target
    chosen = rows.groupBy(*keys).agg(
        F.max_by("threshold", F.when(F.col("recall") >= recall_target, by_f1)).alias("recalled"),
        F.max_by("threshold", by_f1).alias("overall"),
        F.min(F.when(good, F.col("threshold"))).alias("qualified"),
        F.max("positives").alias("validation_positives"),
    )
    return chosen.select(
        *keys,
        F.coalesce("recalled", "overall").alias("candidate"),
        F.coalesce("qualified", F.lit(1.0)).alias("confirmed"),
        (F.col("qualified").isNotNull() & (F.col("validation_positives") >= minimum_positives)).alias(
            "auto_confirm"
        ),
        "validation_positives",
    )


def histogram_metrics(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Binary metrics from a score histogram that carries a ``threshold`` per key."""
    hit = F.col("score") >= F.col("threshold")
    zero = F.lit(0).cast("long")
    counts = hist.groupBy(*keys).agg(
        F.max("_fault").alias("_fault"),
        F.max("threshold").alias("threshold"),
        F.sum("n").alias("samples"),
        F.sum("tp").alias("positives"),
        F.sum(F.when(hit, F.col("n")).otherwise(zero)).alias("predicted_positive"),
        F.sum(F.when(hit, F.col("tp")).otherwise(zero)).alias("true_positive"),
    )
    rated = sound(counts).select(
        "*",
        (F.col("samples") - F.col("positives")).alias("negatives"),
        (F.col("predicted_positive") - F.col("true_positive")).alias("false_positive"),
        (F.col("positives") - F.col("true_positive")).alias("false_negative"),
        ratio(F.col("true_positive"), F.col("predicted_positive")).alias("precision"),
        ratio(F.col("true_positive"), F.col("positives")).alias("recall"),
        ratio(F.col("predicted_positive"), F.col("samples")).alias("coverage"),
    )
    return rated.withColumn("f1", f1_score(F.col("precision"), F.col("recall")))


def validate_thresholds(
    preds: DataFrame,
    *,
    precision_target: float = C.PRECISION_TARGET,
    minimum_positives: int = C.MINIMUM_VALIDATION_POSITIVES,
) -> DataFrame:
    """Search on the calibration split, measure on the evaluation split.

    The held-out rows are collapsed to a histogram before they meet the thresholds, so the join
    sees distinct scores, not rows. Every label of either split has its row: without calibration rows
    the threshold is 1.0 and not enabled, without evaluation rows all counts are 0.
    """
    found = search_threshold(
        applicable(preds, "calibration"),
        ["label"],
        precision_target=precision_target,
        minimum_positives=minimum_positives,
    ).select("label", "threshold", "auto_confirm", "validation_positives")
    heldout = score_histogram(applicable(preds, "evaluation"), ["label"])
    labels = found.select("label").union(heldout.select("label")).distinct()
    placed = join_on(join_on(labels, found.select("label", "threshold"), ["label"], "left"), heldout, ["label"], "left")
    measured = histogram_metrics(placed.fillna({"threshold": 1.0, "n": 0, "tp": 0}), ["label"])
    enabled = (
        F.col("auto_confirm")
        & (F.col("predicted_positive") > 0)
        & (F.col("precision") >= precision_target)
    )
    return (
        join_on(measured, found.drop("threshold"), ["label"], "left")
        .fillna({"auto_confirm": False, "validation_positives": 0})
        .withColumn("enabled", enabled)
    )


def recommend(validated: DataFrame) -> DataFrame:
    """Recommended thresholds rounded to 8 decimals, with the held-out precision and coverage."""
    return validated.select(
        "label",
        F.bround("threshold", 8).alias("confirmed"),
        F.col("enabled").alias("auto_confirm"),
        F.col("validation_positives").alias("calibration_positives"),
        F.bround("precision", 8).alias("heldout_precision"),
        F.bround("coverage", 8).alias("heldout_coverage"),
    )
