"""Evaluation metrics, threshold search, validation and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark.operators.coverage import coverage_cube, data_counts, summary_ratios
from earmark.operators.decisions import product_class
from earmark.operators.fusion import compare_scores
from earmark.operators.metrics import average_precision, binary_metrics, decision_coverage
from earmark.operators.quality import applicable, validate_scores
from earmark.operators.thresholds import (
    calibrate_two,
    recommend,
    search_threshold,
    validate_thresholds,
)
from earmark.plans import adapters as A
from earmark.plans.adapters import profile_sql, with_inputs
from earmark.plans.catalog.registry import register, tidied, tidy
from earmark.sources.dims import with_profile

PROFILE = "calibrated_public_v1"
TIE = ["sample_no", "sample_id"]

RAW_SCORES = """
    SELECT *, CASE WHEN l_linenumber = 7 AND l_suppkey % 10 = 0 THEN 'nan'::DOUBLE ELSE l_quantity / 40 - 0.1::DOUBLE END AS score,
           CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 WHEN l_suppkey % 7 = 0 THEN 2 ELSE 0 END AS target
    FROM lineitem"""


def _raw_scores(spark, d):
    broken = (F.col("l_linenumber") == 7) & (F.col("l_suppkey") % 10 == 0)
    flag = F.col("l_returnflag")
    return A.table(spark, d, "lineitem").select(
        "l_suppkey",
        "l_linenumber",
        F.when(broken, float("nan")).otherwise(F.col("l_quantity") / 40 - 0.1).alias("score"),
        F.when(flag == "R", 1).when(flag == "A", 0).when(F.col("l_suppkey") % 7 == 0, 2).otherwise(0).alias("target"),
    )


@register("validated_scores", tidied(with_inputs([], """
    SELECT l_suppkey, target, count(*) AS n, sum(least(greatest(score, 0.0::DOUBLE), 1.0::DOUBLE)) AS total
    FROM raw WHERE target IN (0, 1) AND NOT isnan(score) GROUP BY ALL""", raw=RAW_SCORES), "total"))
def validated_query(spark, d):
    good, _ = validate_scores(_raw_scores(spark, d), on_bad="quarantine")
    return tidy(good.groupBy("l_suppkey", "target").agg(F.count("*").alias("n"), F.sum("score").alias("total")))


@register("quarantined_scores", with_inputs([], """
    SELECT CASE WHEN target NOT IN (0, 1) THEN 'target_not_binary' ELSE 'score_not_finite' END AS reason, l_suppkey, count(*) AS n
    FROM raw WHERE target NOT IN (0, 1) OR isnan(score) GROUP BY ALL""", raw=RAW_SCORES))
def quarantine_query(spark, d):
    _, bad = validate_scores(_raw_scores(spark, d), on_bad="quarantine")
    return bad.groupBy("reason", "l_suppkey").agg(F.count("*").alias("n"))


@register("applicable_rows", tidied(with_inputs(["doc_predictions"], """
    SELECT sample_id, label, dataset, target, score FROM doc_predictions
    WHERE split = 'evaluation' AND target IS NOT NULL"""), "score"))
def applicable_query(spark, d):
    kept = applicable(A.doc_predictions(spark, d), "evaluation")
    return tidy(kept.select("sample_id", "label", "dataset", "target", "score"))


_METRICS = """
    SELECT *, CASE WHEN predicted_positive > 0 THEN true_positive / predicted_positive ELSE 0.0::DOUBLE END AS precision,
           CASE WHEN positives > 0 THEN true_positive / positives ELSE 0.0::DOUBLE END AS recall,
           predicted_positive / samples AS coverage,
           CASE WHEN true_positive > 0 THEN 2.0::DOUBLE * true_positive / (predicted_positive + positives) ELSE 0.0::DOUBLE END AS f1
    FROM (SELECT {keys}, any_value(threshold) AS threshold, count(*) AS samples, count_if(target = 1)::BIGINT AS positives,
                 count_if(target = 0)::BIGINT AS negatives, count_if(score >= threshold)::BIGINT AS predicted_positive,
                 count_if(score >= threshold AND target = 1)::BIGINT AS true_positive,
                 count_if(score >= threshold AND target = 0)::BIGINT AS false_positive,
                 count_if(score < threshold AND target = 1)::BIGINT AS false_negative
          FROM {source} GROUP BY {keys})"""
_AP = """
    SELECT {keys}, CASE WHEN sum(target) > 0 THEN sum(CASE WHEN target = 1 THEN hits / rk END) / sum(target) ELSE 0.0::DOUBLE END AS pr_auc
    FROM (SELECT {keys}, target, row_number() OVER w AS rk, sum(target) OVER w AS hits FROM {source}
          WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC, {tie} ROWS UNBOUNDED PRECEDING))
    GROUP BY {keys}"""
_RATES = ("threshold", "precision", "recall", "coverage", "f1")


@register("binary_metrics", tidied(with_inputs(["predictions"],
    "SELECT m.*, a.pr_auc FROM (" + _METRICS.format(keys="label", source="leveled") + ") m JOIN ("
    + _AP.format(keys="label", source="leveled", tie="sample_no, sample_id") + ") a USING (label)",
    profile=profile_sql(PROFILE),
    leveled="SELECT p.*, t.confirmed AS threshold FROM predictions p JOIN profile t ON t.canonical_label = p.label"),
    *_RATES, "pr_auc"))
def binary_metrics_query(spark, d):
    preds = with_profile(A.predictions(spark, d), PROFILE, label="label").withColumnRenamed("confirmed", "threshold")
    return tidy(binary_metrics(preds, ["label"], tie_break=TIE))


_AP_SQL = tidied(with_inputs(["predictions"], _AP.format(keys="label", source="predictions", tie="sample_no, sample_id")), "pr_auc")


@register("average_precision", _AP_SQL)
def average_precision_query(spark, d):
    return tidy(average_precision(A.predictions(spark, d), ["label"], TIE))


_TIES_SQL = tidied(with_inputs(["predictions"], _AP.format(keys="label", source="tied", tie="sample_no, sample_id"),
    tied="SELECT * REPLACE (least(greatest(1.5 * score - 0.25, 0.0), 1.0) AS score) FROM predictions"), "pr_auc")


@register("average_precision_large_ties", _TIES_SQL)
def average_precision_large_query(spark, d):
    """Raw scores on both sides of [0, 1]: clipping makes one tie group of a third of all rows."""
    raw = A.predictions(spark, d).withColumn("score", 1.5 * F.col("score") - 0.25)
    return tidy(average_precision(raw, ["label"], TIE))


_LEVELS = """
    SELECT label, score, sum(n) OVER w AS predicted, sum(tp) OVER w AS hits, sum(n) OVER (PARTITION BY label) AS samples,
           sum(tp) OVER (PARTITION BY label) AS positives
    FROM (SELECT label, score, count(*) AS n, sum(target) AS tp FROM {source} GROUP BY label, score)
    WINDOW w AS (PARTITION BY label ORDER BY score DESC)"""
_BEST = """
    SELECT label, min(score) FILTER (hits / predicted >= 0.85::DOUBLE) AS best, any_value(samples)::BIGINT AS samples,
           any_value(positives)::BIGINT AS positives FROM levels GROUP BY label"""
_FOUND = """
    SELECT b.label, coalesce(b.best, 1.0::DOUBLE) AS threshold, coalesce(l.predicted, 0)::BIGINT AS predicted_positive,
           coalesce(l.hits, 0)::BIGINT AS hits, b.samples, b.positives AS validation_positives,
           b.best IS NOT NULL AS meets_precision_target, b.best IS NOT NULL AND b.positives >= 20 AS auto_confirm
    FROM best b LEFT JOIN levels l ON l.label = b.label AND l.score = b.best"""


@register("search_threshold", tidied(with_inputs(["predictions"], """
    SELECT label, threshold, CASE WHEN predicted_positive > 0 THEN hits / predicted_positive ELSE 0.0::DOUBLE END AS precision,
           CASE WHEN validation_positives > 0 THEN hits / validation_positives ELSE 0.0::DOUBLE END AS recall,
           predicted_positive / samples AS coverage, predicted_positive, validation_positives, meets_precision_target, auto_confirm,
           CASE WHEN hits > 0 THEN 2.0::DOUBLE * hits / (predicted_positive + validation_positives) ELSE 0.0::DOUBLE END AS f1
    FROM found""", levels=_LEVELS.format(source="predictions"), best=_BEST, found=_FOUND), *_RATES))
def search_threshold_query(spark, d):
    return tidy(search_threshold(A.predictions(spark, d), ["label"]))


@register("calibrate_two_thresholds", tidied(with_inputs(["predictions"], """
    SELECT label, coalesce(first(score ORDER BY f1 DESC, score) FILTER (recall >= 0.75::DOUBLE),
                           first(score ORDER BY f1 DESC, score)) AS candidate,
           coalesce(min(score) FILTER (precision >= 0.85::DOUBLE), 1.0::DOUBLE) AS confirmed,
           any_value(positives) >= 20 AND count(*) FILTER (precision >= 0.85::DOUBLE) > 0 AS auto_confirm,
           any_value(positives)::BIGINT AS validation_positives
    FROM rated GROUP BY label""",
    grid="""SELECT label, score, sum(n) AS n, sum(tp) AS tp FROM (
              SELECT label, score, 1 AS n, target AS tp FROM predictions
              UNION ALL SELECT DISTINCT label, s, 0, 0 FROM predictions, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) AS t(s)) GROUP BY label, score""",
    levels="""SELECT label, score, sum(n) OVER w AS predicted, sum(tp) OVER w AS hits, sum(tp) OVER (PARTITION BY label) AS positives
              FROM grid WINDOW w AS (PARTITION BY label ORDER BY score DESC)""",
    rated="""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1
             FROM (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 1.0::DOUBLE END AS precision,
                          CASE WHEN positives > 0 THEN hits / positives ELSE 0.0::DOUBLE END AS recall FROM levels)"""),
    "candidate", "confirmed"))
def calibrate_query(spark, d):
    return tidy(calibrate_two(A.predictions(spark, d), ["label"]))


_COUNTS = """
    count(*) AS samples, count_if(target = 1)::BIGINT AS positives, count_if(decision = 'confirmed')::BIGINT AS confirmed_count,
    count_if(decision = 'candidate')::BIGINT AS candidate_count, count_if(decision = 'unknown')::BIGINT AS unknown_count,
    count_if(decision = 'confirmed' AND target = 1)::BIGINT AS confirmed_true_positive,
    count_if(decision = 'candidate' AND target = 1)::BIGINT AS candidate_true_positive"""
_COVERAGES = """
    confirmed_count / samples AS confirmed_coverage, candidate_count / samples AS candidate_coverage,
    (confirmed_count + candidate_count) / samples AS prefill_coverage, unknown_count / samples AS unknown_coverage,
    CASE WHEN confirmed_count > 0 THEN confirmed_true_positive / confirmed_count ELSE 0.0::DOUBLE END AS confirmed_precision,
    CASE WHEN candidate_count > 0 THEN candidate_true_positive / candidate_count ELSE 0.0::DOUBLE END AS candidate_precision"""
_COVERAGE_DOUBLES = ("confirmed_coverage", "candidate_coverage", "prefill_coverage", "unknown_coverage",
                     "confirmed_precision", "candidate_precision")


def _made(source: str, where: str = "true") -> dict[str, str]:
    return {
        "profile": profile_sql(PROFILE),
        "made": f"""SELECT p.*, CASE WHEN t.auto_confirm AND p.score >= t.confirmed THEN 'confirmed'
                                WHEN p.score >= t.candidate THEN 'candidate' ELSE 'unknown' END AS decision
                    FROM {source} p JOIN profile t ON t.canonical_label = p.label WHERE {where}""",
    }


@register("decision_coverage", tidied(with_inputs(["predictions"],
    f"SELECT *, {_COVERAGES} FROM (SELECT label, {_COUNTS} FROM made GROUP BY label)", **_made("predictions")), *_COVERAGE_DOUBLES))
def decision_coverage_query(spark, d):
    return tidy(decision_coverage(with_profile(A.predictions(spark, d), PROFILE, label="label"), ["label"]))


_CUBE = f"""
    SELECT *, {_COVERAGES} FROM (
        SELECT CASE WHEN grouping(label) = 1 THEN '*' ELSE label END AS label,
               CASE WHEN grouping(dataset) = 1 THEN '*' ELSE dataset END AS dataset, {_COUNTS}
        FROM made GROUP BY GROUPING SETS ((label, dataset), (label), (dataset), ()))"""
_EVAL = "p.split = 'evaluation' AND p.target IS NOT NULL"


@register("coverage_cube", tidied(with_inputs(["predictions"], _CUBE, **_made("predictions", _EVAL)), *_COVERAGE_DOUBLES))
def coverage_cube_query(spark, d):
    return tidy(coverage_cube(A.predictions(spark, d), PROFILE))


@register("coverage_cube_absent_cells", tidied(with_inputs(["doc_predictions"], _CUBE, **_made("doc_predictions", _EVAL)), *_COVERAGE_DOUBLES))
def coverage_docs_query(spark, d):
    return tidy(coverage_cube(A.doc_predictions(spark, d), PROFILE))


_TOTAL = f"SELECT *, {_COVERAGES} FROM (SELECT {_COUNTS} FROM made)"


@register("summary_ratios", tidied(with_inputs(["predictions"], f"""
    SELECT samples, positives, confirmed_count, candidate_count, unknown_count, {', '.join(_COVERAGE_DOUBLES)},
           confirmed_true_positive / positives AS positive_recall, samples * 10 AS form_fields,
           confirmed_count + candidate_count AS form_prefilled, (confirmed_count + candidate_count) / (samples * 10) AS form_prefill_coverage
    FROM ({_TOTAL})""", **_made("predictions", _EVAL)), *_COVERAGE_DOUBLES, "positive_recall", "form_prefill_coverage"))
def summary_query(spark, d):
    return tidy(summary_ratios(coverage_cube(A.predictions(spark, d), PROFILE)))


@register("product_class", with_inputs(["predictions"], f"""
    SELECT CASE WHEN confirmed_precision < 0.9::DOUBLE THEN 'C' ELSE 'B' END AS product_class,
           confirmed_precision >= 0.9::DOUBLE AS precision_passed, prefill_coverage >= 0.4::DOUBLE AS prefill_passed
    FROM ({_TOTAL})""", **_made("predictions", _EVAL)))
def product_class_query(spark, d):
    return product_class(summary_ratios(coverage_cube(A.predictions(spark, d), PROFILE)))


_VALIDATED = {
    "calibration": "SELECT * FROM predictions WHERE split = 'calibration'",
    "levels": _LEVELS.format(source="calibration"),
    "best": _BEST,
    "found": _FOUND,
    "leveled": "SELECT p.*, f.threshold FROM predictions p JOIN found f USING (label) WHERE p.split = 'evaluation'",
    "validated": "SELECT m.*, f.auto_confirm, f.validation_positives, f.auto_confirm AND m.predicted_positive > 0 AND m.precision >= 0.85::DOUBLE AS enabled FROM ("
    + _METRICS.format(keys="label", source="leveled") + ") m JOIN found f USING (label)",
}


@register("holdout_validation", tidied(with_inputs(["predictions"], "SELECT * FROM validated", **_VALIDATED), *_RATES))
def holdout_query(spark, d):
    return tidy(validate_thresholds(A.predictions(spark, d)))


@register("recommended_thresholds", tidied(with_inputs(["predictions"], """
    SELECT label, round(threshold, 8) AS confirmed, enabled AS auto_confirm, validation_positives AS calibration_positives,
           round(precision, 8) AS heldout_precision, round(coverage, 8) AS heldout_coverage FROM validated""", **_VALIDATED),
    "confirmed", "heldout_precision", "heldout_coverage"))
def recommend_query(spark, d):
    return tidy(recommend(validate_thresholds(A.predictions(spark, d))))


@register("data_counts", with_inputs(["predictions"], """
    SELECT c.dataset, c.split, count(DISTINCT p.sample_id) AS audio, count(p.sample_id) AS decisions
    FROM (SELECT * FROM (VALUES ('set_a'), ('set_b'), ('set_c')) AS x(dataset), (VALUES ('calibration'), ('evaluation')) AS y(split)) c
    LEFT JOIN predictions p USING (dataset, split) GROUP BY ALL"""))
def data_counts_query(spark, d):
    return data_counts(A.predictions(spark, d), ["set_a", "set_b", "set_c"], ["calibration", "evaluation"])


@register("compare_score_columns", tidied(with_inputs(["predictions"],
    "SELECT m.*, a.pr_auc FROM (" + _METRICS.format(keys="label, variant", source="variants") + ") m JOIN ("
    + _AP.format(keys="label, variant", source="variants", tie="sample_no, sample_id") + ") a USING (label, variant)",
    profile=profile_sql(PROFILE),
    variants="""SELECT p.label, p.target, p.sample_no, p.sample_id, t.candidate AS threshold, v.variant,
                       CASE v.variant WHEN 'mix_score' THEN p.score ELSE p.score * p.score END AS score
                FROM predictions p JOIN profile t ON t.canonical_label = p.label, (VALUES ('mix_score'), ('fused_score')) AS v(variant)"""),
    *_RATES, "pr_auc"))
def compare_query(spark, d):
    preds = A.predictions(spark, d).select(
        F.col("label").alias("canonical_label"), "target", *TIE, F.col("score").alias("mix_score"),
        (F.col("score") * F.col("score")).alias("fused_score"),
    )
    return tidy(compare_scores(preds, ["mix_score", "fused_score"], PROFILE, TIE))
