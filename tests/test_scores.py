"""Statistics, decisions and label mapping on literal values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from earmark import constants as C
from earmark.functions.columns import value_bucket
from earmark.functions.ordered import (
    dense_index,
    order_statistics,
    ordered_changes,
    previous_value,
    running_totals,
)
from earmark.operators.decisions import decide, demote_ambiguous
from earmark.operators.labels import canonical_scores, canonical_scores_dense, explode_scores, fold_partial, tags_to_targets
from earmark.operators.scores import presence_score, score_statistics
from earmark.plans.activity import label_decisions
from earmark.sources.dims import interval_rule_dim, profile_dim, with_profile


def windows(spark, labels, rows):
    data = [("c", i, float(i), float(i + 1), list(map(float, r))) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "clip_id string, window_idx long, start_s double, end_s double, scores array<double>")


def test_statistics_of_five_scores(spark):
    rows = [("c", "guitar", s) for s in (0.1, 0.2, 0.8, 0.9, 1.0)]
    canonical = spark.createDataFrame(rows, "clip_id string, canonical_label string, score double")
    # candidate threshold of guitar is 0.3, so three of five are active
    for limit in (200_000, 2):
        row = score_statistics(canonical, "default", limit=limit).first()
        assert row.top_mean == pytest.approx(1.0)
        assert row.active_ratio == pytest.approx(0.6)
        assert row.p95 == pytest.approx(0.98)
        assert row.median == pytest.approx(0.8)
        assert row["mean"] == pytest.approx(0.6)


@pytest.mark.parametrize("limit", [10_000, 3])
def test_order_statistics_match_numpy_for_small_and_large_groups(spark, limit):
    rng = np.random.default_rng(3)
    groups = {k: np.round(rng.normal(size=n), 2) * (-1 if k % 2 else 1) for k, n in enumerate((1, 2, 5, 37, 120))}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k int, x double")
    got = order_statistics(
        df, ["k"], {"q10": ("x", 0.1), "q50": ("x", 0.5), "q95": ("x", 0.95)},
        top_means={"top": ("x", 0.2)}, aggregates={"n": F.count("*")}, limit=limit,
    ).collect()
    assert len(got) == len(groups)
    for row in got:
        x = groups[row.k]
        assert row.q10 == pytest.approx(np.percentile(x, 10))
        assert row.q50 == pytest.approx(np.percentile(x, 50))
        assert row.q95 == pytest.approx(np.percentile(x, 95))
        assert row.top == pytest.approx(np.sort(x)[-max(1, math.ceil(len(x) * 0.2)):].mean())
        assert row.n == len(x)


@pytest.mark.parametrize("limit", [10_000, 3])
def test_order_statistics_without_key_and_with_nulls(spark, limit):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (7.0,), (9.0,)], "x double")
    row = order_statistics(df, [], {"m": ("x", 0.5)}, aggregates={"n": F.count("*")}, limit=limit).first()
    assert row.m == 5.0 and row.n == 5


def test_value_bucket_keeps_order(spark):
    values = [-1e30, -5.0, -1.0001, -1.0, -1e-300, 0.0, 5e-324, 1e-9, 0.1, 0.1000001, 1.0, 3.5, 1e200]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r.b for r in df.select("v", value_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert buckets == sorted(buckets)
    assert buckets[5] == 0 and buckets[4] < 0 < buckets[6]


def test_running_totals_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v), int(n)) for k in range(3) for v, n in zip(rng.permutation(200) / 200, rng.integers(1, 9, 200))]
    got = running_totals(spark.createDataFrame(rows, "k int, v double, n long"), ["k"], "v", ["n"], descending=True)
    expected = {}
    for k in range(3):
        total = 0
        for _, v, n in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]):
            expected[k, v] = total
            total += n
    assert {(r.k, r.v): r.n_before for r in got.collect()} == expected


@pytest.mark.parametrize("limit", [1000, 5])
def test_dense_index(spark, limit):
    df = spark.createDataFrame([(k, v % 41, v) for k in (1, 2) for v in range(100)], "k int, a int, b int")
    got = dense_index(df, ["k"], ["a", "b"], "i", limit=limit).collect()
    for k in (1, 2):
        rows = sorted((r for r in got if r.k == k), key=lambda r: (r.a, r.b))
        assert [r.i for r in rows] == list(range(100))


def test_previous_value_and_changes_across_slices(spark):
    data = [(1, i, float((i * 7) % 5)) for i in range(50)]
    df = spark.createDataFrame(data, "k int, i long, x double")
    before = {r.i: r.p for r in previous_value(df, ["k"], "i", "x", "p", slice_rows=8).collect()}
    assert before == {i: (data[i - 1][2] if i else None) for i in range(50)}
    row = ordered_changes(df, ["k"], "i", "x", lambda a, b: F.abs(b - a), slice_of=F.floor(F.col("i") / 8),
                          total="moved", pairs="pairs").first()
    assert row.moved == pytest.approx(sum(abs(data[i][2] - data[i - 1][2]) for i in range(1, 50)))
    assert row.pairs == 49


def test_uncalibrated_labels_stay_candidates(spark):
    labels = ["drums", "acousticguitar", "electricguitar"]
    dense = canonical_scores_dense(windows(spark, labels, [[0.99, 0.9, 0.88]] * 2), labels)
    rows = label_decisions(dense, "default").collect()
    assert {r.canonical_label for r in rows} == {"drums", "acoustic_guitar", "electric_guitar"}
    assert {r.decision for r in rows} == {C.CANDIDATE}


def test_dense_and_long_mapping_agree(spark):
    labels = ["doublebass", "bass", "violin", "piano"]
    w = windows(spark, labels, [[0.9, 0.1, 0.3, 0.2], [0.0, 0.4, 0.1, 0.7]])
    long = canonical_scores(explode_scores(w, labels))
    dense = canonical_scores_dense(w, labels)
    key = ["clip_id", "window_idx", "canonical_label", "start_s", "end_s", "score"]
    assert sorted(map(tuple, long.select(key).collect())) == sorted(map(tuple, dense.select(key).collect()))
    scores = {(r.window_idx, r.canonical_label): r.score for r in dense.collect()}
    assert scores[0, "bass"] == scores[0, "strings"] == 0.9
    assert "drums" not in {label for _, label in scores}


def test_confirmed_needs_the_flag_and_comes_first(spark):
    rows = [("low", 0.2, 0.30, 0.13, True), ("off", 0.9, 0.30, 0.70, False), ("none", 0.1, 0.30, 0.13, True)]
    df = spark.createDataFrame(rows, "id string, score double, candidate double, confirmed double, auto_confirm boolean")
    got = {r.id: r.decision for r in decide(df).collect()}
    assert got == {"low": C.CONFIRMED, "off": C.CANDIDATE, "none": C.UNKNOWN}


def test_ambiguous_subtypes_are_demoted(spark):
    rows = [
        ("near", "acoustic_guitar", "confirmed", 0.90), ("near", "electric_guitar", "confirmed", 0.85),
        ("near", "piano", "confirmed", 0.88),
        ("far", "acoustic_guitar", "confirmed", 0.90), ("far", "electric_guitar", "candidate", 0.50),
        ("one", "acoustic_guitar", "confirmed", 0.90),
    ]
    df = spark.createDataFrame(rows, "clip_id string, canonical_label string, decision string, score double")
    got = {(r.clip_id, r.canonical_label): r.decision for r in demote_ambiguous(df).collect()}
    assert got["near", "acoustic_guitar"] == got["near", "electric_guitar"] == C.CANDIDATE
    assert got["near", "piano"] == got["far", "acoustic_guitar"] == got["one", "acoustic_guitar"] == C.CONFIRMED


def test_presence_weights(spark):
    df = spark.createDataFrame([(0.8, 0.6)], "top_mean double, p95 double")
    assert presence_score(df).first().score == pytest.approx(0.65 * 0.8 + 0.35 * 0.6)


def test_profiles_are_allow_listed(spark):
    assert profile_dim(spark, "calibrated_public_v1").count() == 16
    with pytest.raises(ValueError):
        profile_dim(spark, "../other")
    row = with_profile(spark.createDataFrame([("theremin",)], "canonical_label string"), "default").first()
    assert (row.candidate, row.confirmed, row.auto_confirm) == (0.30, 0.70, False)


def test_interval_rules_fall_back_per_key(spark):
    rules = {"piano": {"gap_s": 9.0}, "bass": {"transient": (False, 5)}, "pad": {"transient": (True, 4)}}
    got = {r.canonical_label: r for r in interval_rule_dim(spark, rules=rules).collect()}
    assert (got["piano"].gap_s, got["piano"].release_ratio) == (9.0, 0.80)
    assert got["bass"].min_windows == 1 and got["pad"].min_windows == 4
    with pytest.raises(ValueError):
        interval_rule_dim(spark, rules={"piano": {"ratio": 1.2}})


def test_partial_judgments_make_no_negatives(spark):
    values, masks = [0.0] * 20, [0] * 20
    values[6], masks[6] = 1.0, 1
    masks[3], values[3] = 1, 0.1          # cello judged false, violin not judged
    masks[15] = masks[16] = 1             # trombone and trumpet judged false
    df = spark.createDataFrame([("a", values, masks)], "id string, v array<double>, m array<int>")
    got = {r.label: r.target for r in fold_partial(df, key="id", values="v", masks="m").collect()}
    assert got["drums"] is True and got["piano"] is None
    assert got["strings"] is None and got["brass"] is False and got["electric_guitar"] is None


def test_tags_give_total_targets(spark):
    df = spark.createDataFrame([("a", ["conga", "cello"]), ("b", [])], "id string, tags array<string>")
    got = {(r.id, r.label): r.target for r in tags_to_targets(df, key="id", tags="tags").collect()}
    assert got["a", "percussion"] and got["a", "strings"] and not got["a", "drums"]
    assert len(got) == 20 and None not in got.values()
