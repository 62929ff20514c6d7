from fractions import Fraction

"""Metrics, threshold search and coverage."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from earmark.operators.coverage import coverage_cube, data_counts
from earmark.operators.metrics import average_precision, binary_metrics, decision_coverage
from earmark.operators.quality import exit_code, validate_scores, with_failures
from earmark.operators.thresholds import calibrate_two, search_threshold


def preds(spark, groups):
    rows = [(k, i, t, float(s)) for k, (ts, ss) in groups.items() for i, (t, s) in enumerate(zip(ts, ss))]
    return spark.createDataFrame(rows, "label string, no long, target int, score double")


def one(spark, targets, scores):
    return preds(spark, {"a": (targets, scores)})


def test_perfect_ranking(spark):
    df = one(spark, [1, 0, 1, 0], [0.9, 0.2, 0.8, 0.1])
    assert average_precision(df, ["label"], ["no"]).first().pr_auc == 1.0


def test_threshold_of_largest_coverage(spark):
    df = one(spark, [1, 1, 1, 0, 0], [0.95, 0.8, 0.7, 0.75, 0.1])
    row = search_threshold(df, ["label"], precision_target=0.75, minimum_positives=3).first()
    assert (row.threshold, row.precision, row.predicted_positive) == (0.7, 0.75, 4)
    assert row.meets_precision_target and row.auto_confirm


def test_few_positives_disable_auto_confirmation(spark):
    row = search_threshold(one(spark, [1, 0], [0.9, 0.1]), ["label"], precision_target=0.85, minimum_positives=2).first()
    assert row.meets_precision_target and not row.auto_confirm


def test_no_qualified_threshold(spark):
    row = search_threshold(one(spark, [0, 0, 1], [0.9, 0.5, 0.2]), ["label"]).first()
    assert (row.threshold, row.precision, row.predicted_positive, row.meets_precision_target) == (1.0, 0.0, 0, False)


def test_coverage_over_all_decisions(spark):
    df = one(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]).withColumn("threshold", F.lit(0.75))
    row = binary_metrics(df, ["label"], tie_break=["no"]).first()
    assert (row.coverage, row.precision, row.recall, row.false_negative) == (0.5, 0.5, 0.5, 1)


def test_three_way_coverage(spark):
    df = one(spark, [1, 1, 0, 0], [0.9, 0.6, 0.4, 0.1]).select(
        "*", F.lit(0.3).alias("candidate"), F.lit(0.8).alias("confirmed"), F.lit(True).alias("auto_confirm"))
    row = decision_coverage(df, ["label"]).first()
    assert (row.confirmed_count, row.candidate_count, row.unknown_count) == (1, 2, 1)
    assert (row.prefill_coverage, row.confirmed_precision, row.candidate_precision) == (0.75, 1.0, 0.5)
    off = decision_coverage(df.withColumn("auto_confirm", F.lit(False)), ["label"]).first()
    assert off.confirmed_count == 0 and off.candidate_count == 3 and off.confirmed_precision == 0.0


def _ap(targets, scores):
    """For each positive the share of positives among the rows not ranked below it, on average."""
    rows = [(-score, no) for no, score in enumerate(scores)]
    true = [row for row, t in zip(rows, targets) if t]
    shares = [sum(other <= row for other in true) / sum(other <= row for other in rows) for row in true]
    return sum(shares) / len(shares) if shares else 0.0


def _search(targets, scores, goal=0.85):
    t, s = np.asarray(targets), np.asarray(scores)
    best = [x for x in sorted(set(scores)) if t[s >= x].mean() >= goal]
    return best[0] if best else 1.0


def _two(targets, scores):
    """Both thresholds from sets of row numbers and exact fractions."""
    true = {no for no, t in enumerate(targets) if t}
    levels = {0.0, 1.0, *scores}
    hits = {x: {no for no, s in enumerate(scores) if s >= x} for x in levels}
    recall = {x: Fraction(len(hits[x] & true), len(true) or 1) for x in levels}
    precise = {x: Fraction(len(hits[x] & true), len(hits[x])) if hits[x] else Fraction(1) for x in levels}
    f1 = {x: 2 / (1 / precise[x] + 1 / recall[x]) if precise[x] and recall[x] else Fraction(0) for x in levels}
    wide = {x for x in levels if recall[x] >= Fraction(3, 4)} or levels
    best = max(f1[x] for x in wide)
    confirmed = [x for x in levels if precise[x] >= Fraction(17, 20)]
    return {x for x in wide if f1[x] == best}, min(confirmed, default=1.0)


group = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 8).map(lambda x: x / 8)), min_size=1, max_size=40)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(group, min_size=25, max_size=25))
def test_random_groups_equal_plain_loops(spark, groups):
    data = {str(k): tuple(zip(*g)) for k, g in enumerate(groups)}
    df = preds(spark, data)
    ap = {r.label: r.pr_auc for r in average_precision(df, ["label"], ["no"]).collect()}
    assert ap.keys() == data.keys()
    for k, (t, s) in data.items():
        assert ap[k] == pytest.approx(_ap(t, s))
    found = {r.label: r.threshold for r in search_threshold(df, ["label"]).collect()}
    two = {r.label: (r.candidate, r.confirmed) for r in calibrate_two(df, ["label"]).collect()}
    for k, (t, s) in data.items():
        assert found[k] == _search(t, s)
        best, confirmed = _two(t, s)
        assert two[k][0] in best and two[k][1] == confirmed


def test_empty_prediction_counts_as_precise_only_in_the_second_rule(spark):
    df = one(spark, [0] * 5 + [1] * 25, [0.9] * 5 + [0.2] * 25)
    row = calibrate_two(df, ["label"], precision_target=0.95).first()
    assert row.confirmed == 1.0 and row.auto_confirm
    assert not search_threshold(df, ["label"], precision_target=0.95).first().meets_precision_target


def test_bad_scores_fail_or_are_kept_apart(spark):
    rows = [(1, 0.5), (0, 1.7), (2, 0.1), (1, float("nan")), (0, float("inf")), (1, -2.0)]
    df = spark.createDataFrame(rows, "target int, score double")
    good, bad = validate_scores(df, on_bad="quarantine")
    assert sorted(r.score for r in good.collect()) == [0.0, 0.5, 1.0]
    assert sorted(r.reason for r in bad.collect()) == ["score_not_finite", "score_not_finite", "target_not_binary"]
    with pytest.raises(Exception, match="unusable labelled score"):
        validate_scores(df).collect()


def test_failures_go_aside(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    fine, failed = with_failures(df, F.when(F.col("x") == 2, "odd"))
    assert fine.count() == 1 and failed.first().error == "odd"
    assert exit_code(failed) == 2 and exit_code(failed.filter("false")) == 0


def test_counts_keep_empty_cells_and_cube_omits_absent_pairs(spark):
    rows = [("s1", "a", "evaluation", "bass", 1, 0.9), ("s2", "b", "evaluation", "piano", 0, 0.1),
            ("s1", "a", "evaluation", "piano", None, 0.5)]
    df = spark.createDataFrame(rows, "sample_id string, dataset string, split string, label string, target int, score double")
    counts = {(r.dataset, r.split): (r.audio, r.decisions) for r in data_counts(df, ["a", "b"], ["calibration", "evaluation"]).collect()}
    assert counts[("a", "calibration")] == (0, 0) and counts[("a", "evaluation")] == (1, 2)
    cube = {(r.label, r.dataset): r.samples for r in coverage_cube(df, "default").collect()}
    assert cube == {("bass", "a"): 1, ("piano", "b"): 1, ("bass", "*"): 1, ("piano", "*"): 1, ("*", "a"): 1, ("*", "b"): 1, ("*", "*"): 2}
