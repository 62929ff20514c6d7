"""Coverage cube over label and dataset, data counts and summary ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from earmark import constants as C
from earmark.functions.columns import literal_table, ratio
from earmark.operators.metrics import decision_counts, decision_ratios
from earmark.operators.quality import applicable, judged, sound
from earmark.sources.dims import with_profile

ALL = "*"


def coverage_cube(preds: DataFrame, profile: str, *, split: str = "evaluation") -> DataFrame:
    """Decision coverage per (label, dataset), label, dataset and in total; ``*`` stands for all.

    Rows are counted once per (label, dataset); the grouping sets run over those few counts.
    """
    leveled = with_profile(judged(applicable(preds, split)), profile, label="label")
    cells = leveled.groupBy("label", "dataset").agg(*decision_counts(leveled), F.max("_fault").alias("_fault"))
    cells = sound(cells)
    counts = [c for c in cells.columns if c not in ("label", "dataset")]
    label, dataset = F.col("label"), F.col("dataset")
    cube = cells.groupingSets([[label, dataset], [label], [dataset], []], label, dataset).agg(
        *[F.sum(c).alias(c) for c in counts],
        F.grouping("label").alias("_all_labels"),
        F.grouping("dataset").alias("_all_datasets"),
    )
    named = cube.select(
        F.when(F.col("_all_labels") == 1, ALL).otherwise(label).alias("label"),
        F.when(F.col("_all_datasets") == 1, ALL).otherwise(dataset).alias("dataset"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )
    return decision_ratios(named)


def summary_ratios(cube: DataFrame) -> DataFrame:
    """Form-equivalent coverage and recall of positives, from the cube's total row."""
    prefilled = F.col("confirmed_count") + F.col("candidate_count")
    fields = F.col("samples") * C.FIELDS_PER_DECISION
    return cube.filter((F.col("label") == ALL) & (F.col("dataset") == ALL)).select(
        "samples",
        "positives",
        "confirmed_count",
        "candidate_count",
        "unknown_count",
        "confirmed_coverage",
        "candidate_coverage",
        "prefill_coverage",
        "unknown_coverage",
        "confirmed_precision",
        "candidate_precision",
        ratio(F.col("confirmed_true_positive"), F.col("positives")).alias("positive_recall"),
        fields.alias("form_fields"),
        prefilled.alias("form_prefilled"),
        ratio(prefilled, fields).alias("form_prefill_coverage"),
    )


def data_counts(preds: DataFrame, datasets: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Distinct samples and decisions per dataset and split; every cell appears, even at zero."""
    cells = literal_table(
        preds.sparkSession, "dataset string, split string", [(d, s) for d in datasets for s in splits]
    )
    per_sample = preds.groupBy("dataset", "split", "sample_id").agg(F.count("*").alias("n"))
    counted = per_sample.groupBy("dataset", "split").agg(
        F.count("*").alias("audio"), F.sum("n").alias("decisions")
    )
    return cells.join(counted, ["dataset", "split"], "left").fillna(0, subset=["audio", "decisions"])
