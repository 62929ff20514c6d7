"""Results do not change at the size limits, whatever the rows hold."""

import math

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from earmark.functions.columns import FINE_PER_OCTAVE, value_bucket
from earmark.functions import ordered
from earmark.functions.ordered import counted_slices, dense_index, order_statistics
from earmark.operators.framing import frame_counts, frame_table
from earmark.operators.metrics import average_precision, binary_metrics
from earmark.operators.sampling import late_fetch
from earmark.operators.thresholds import search_threshold, validate_thresholds
from earmark.operators.timbre import envelope_features, spectral_features
from earmark.plans.activity import label_intervals
from earmark.session import stored

NAN, INF = float("nan"), float("inf")


def _same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or a == pytest.approx(b)))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("keys", [["k"], []])
def test_order_statistics_with_odd_values(spark, keys):
    data = [("a", x) for x in (0.1, 0.2, 0.9, 5.0, 7.0, NAN, NAN)] + [("b", None)] * 5
    data += [(None, x) for x in (1.0, None, -2.0, 3.0)] + [("c", x) for x in (-INF, 0.0, INF, 4.0)]
    df = spark.createDataFrame(data, "k string, x double")

    def stats(limit):
        return _rows(order_statistics(df, keys, {"p50": ("x", 0.5), "p90": ("x", 0.9)}, top_means={"top": ("x", 0.2)}, limit=limit))

    small, large = stats(10**6), stats(2)
    assert len(small) == len(large) == (4 if keys else 1)
    assert all(_same(x, y) for a, b in zip(small, large) for x, y in zip(a, b))


def test_dense_index_with_null_keys_and_orders(spark):
    data = [(k, x, n) for n, (k, x) in enumerate([(None, 1.0), (None, None), (None, -1.0), ("a", NAN), ("a", INF), ("a", None), ("a", -3.0)])]
    df = spark.createDataFrame(data, "k string, x double, n int")
    small, large = (_rows(dense_index(df, ["k"], ["x", "n"], "i", limit=limit)) for limit in (10**6, 2))
    assert str(small) == str(large) and len(small) == 7


def test_average_precision_keeps_a_null_label(spark):
    data = [(lab, t, s, n) for n, (lab, t, s) in enumerate([(None, 1, 0.9), (None, 0, 0.9), (None, 1, 0.2), ("a", 1, 1.7), ("a", 0, 1.2), ("a", 1, -0.3)])]
    df = spark.createDataFrame(data, "label string, target int, score double, no int")
    few, many = (_rows(average_precision(df.repartition(n), ["label"], ["no"])) for n in (1, 5))
    assert few == many and len(few) == 2
    assert {r.label for r in search_threshold(df, ["label"]).collect()} == {None, "a"}


def test_metrics_clip_scores_and_refuse_unusable_ones(spark):
    df = spark.createDataFrame([("a", 1, 1.7, 0.5, 0), ("a", 0, -0.3, 0.5, 1)], "label string, target int, score double, threshold double, no int")
    row = binary_metrics(df, ["label"]).first()
    assert (row.predicted_positive, row.true_positive) == (1, 1)
    assert search_threshold(df, ["label"]).first().threshold == 1.0
    for bad in (F.lit(NAN), F.lit(None).cast("double")):
        with pytest.raises(Exception, match="unusable labelled score"):
            binary_metrics(df.withColumn("score", bad), ["label"]).collect()


def test_labels_of_one_split_stay(spark):
    data = [(s, lab, t, x) for s, lab in (("calibration", "a"), ("evaluation", "a"), ("evaluation", "b"), ("calibration", "c")) for t, x in ((1, 0.9), (0, 0.1))]
    df = spark.createDataFrame(data, "split string, label string, target int, score double")
    got = {r.label: r for r in validate_thresholds(df, minimum_positives=1).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].enabled
    assert got["b"].threshold == 1.0 and not got["b"].enabled and got["b"].samples == 2
    assert got["c"].samples == 0 and not got["c"].enabled


def test_a_label_without_rule_gets_the_fallback(spark):
    data = [(None, lab, i, float(i), i + 1.0, 0.9) for lab in ("bass", "kazoo") for i in range(10)]
    df = spark.createDataFrame(data, "clip_id long, canonical_label string, window_idx int, start_s double, end_s double, score double")
    for slice_rows in (None, 3.0):
        got = {(r.canonical_label, r.start_s, r.end_s) for r in label_intervals(df, "default", rules={"kazoo": {}}, slice_rows=slice_rows).collect()}
        assert got == {("bass", 0.0, 10.0), ("kazoo", 0.0, 10.0)}


def test_no_join_is_forced_by_declared_sizes(spark):
    wide = spark.range(10).withColumn("x", F.col("id"))
    plan = late_fetch(wide.select("id"), wide, "id", ["x"])._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plan


def test_hot_keys_are_cut_by_their_own_rows(spark):
    n, limit = 200_000, 2_000
    df = spark.range(n).select(
        F.when(F.col("id") % 200 == 0, "usual").otherwise("hot").alias("k"),
        (F.col("id") * 3600 / n).alias("start_s"),
        (0.999 + F.col("id") * 0.001 / n).alias("score"),
        F.format_string("sample_000%09d", "id").alias("name"),
        (F.col("id") + 1_700_000_000).alias("no"),
    )
    cut = {(r.k, r._slice): r["count"] for r in counted_slices(df, ["k"], "start_s", limit).groupBy("k", "_slice").count().collect()}
    assert max(cut.values()) <= 2 * limit and [k for k, _ in cut].count("usual") == 1
    assert len(cut) > n / limit / 2
    crowded = df.groupBy(value_bucket(F.col("score"), FINE_PER_OCTAVE)).count().agg(F.max("count")).first()[0]
    assert crowded <= 2 * limit


def test_running_totals_deal_a_hot_tie_group_evenly(spark, monkeypatch):
    """One key, one score, and an outlying tie-break elsewhere: parts of about equal size, exact totals."""
    n = 40_000
    df = spark.range(n).select(
        F.when(F.col("id") < 3, "other").otherwise("hot").alias("_key"),  # a clashing name
        F.when(F.col("id") < 3, F.col("id") / 4.0).otherwise(F.lit(1.0)).alias("score"),
        F.when(F.col("id") == 0, "~outlier").otherwise(F.format_string("sample_000%09d", "id")).alias("name"),
        F.lit(1).cast("long").alias("n"),
    )
    kept = {}
    monkeypatch.setattr(ordered, "stored", lambda d, name: kept.setdefault(name, stored(d, name)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is too small to be cut otherwise
    try:
        got = ordered.running_totals(df, ["_key"], "score", ["n"], descending=True, then=["name"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in kept["ordered"].groupBy("_part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) <= 2 * n / len(sizes)
    hot = got.filter("_key = 'hot'").orderBy("name").collect()
    assert [r.n_before for r in hot] == list(range(n - 3)) and {r.n_total for r in hot} == {n - 3}
    rest = {r.name: r.n_before for r in got.filter("_key = 'other'").collect()}
    assert sorted(rest.values()) == [0, 1, 2] and rest["~outlier"] == 2


def test_parts_of_an_order_do_not_grow_with_the_table(spark, monkeypatch):
    """More parts than the session has shuffle partitions, and few rows in any task; the totals are the same."""
    kept = {}
    monkeypatch.setattr(ordered, "PART_ROWS", 500, raising=False)
    monkeypatch.setattr(ordered, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    rows = spark.range(12_000).select("id", (F.col("id") * 7919 % 12_000).alias("x"), F.lit("hot").alias("k"), F.lit(1).alias("n"))
    got = ordered.running_totals(rows, ["k"], "x", ["n"])
    assert all(r.n_before == r.x and r.n_total == 12_000 for r in got.collect())
    sizes = [r["count"] for r in kept["ordered"].groupBy("_part").count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 1_000
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 10


def test_metric_plans_scan_once_and_fail_late(spark):
    """One range shuffle and the stored rows instead of a self-join of the scan; no error expression on rows."""
    sf = "/root/testdata/sf0.001"
    for name in ("search_threshold", "average_precision", "binary_metrics"):
        text = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in text, name  # the rows come from the store
        assert text.count("Exchange hashpartitioning") + text.count("Exchange rangepartitioning") <= 4, name
        assert text.count("raise_error") == 1, name


def test_frames_are_counted_not_declared(spark):
    """A spectrum of few bins a frame, and clips of unequal length: sizes hold, and both ways give the same rows."""
    spectrum = spark.range(4_000).select(
        F.when(F.col("id") < 3_600, "long").otherwise("short").alias("clip_id"), F.floor(F.col("id") / 4).alias("frame"),
        ((F.col("id") % 4) * 1000.0).alias("freq_hz"), (1 + F.col("id") * 7 % 13).cast("double").alias("magnitude"),
    )
    usual, sliced = (_rows(spectral_features(spectrum, limit=n)) for n in (10**6, 500))
    assert len(usual) == 2 and all(_same(a, b) for x, y in zip(usual, sliced) for a, b in zip(x, y))
    mono = spark.range(5_000).select(F.when(F.col("id") < 4_500, "long").otherwise("short").alias("clip_id"), "id")
    mono = mono.select("clip_id", F.when(F.col("clip_id") == "long", F.col("id")).otherwise(F.col("id") - 4_500).alias("i"), F.sin(F.col("id") / 9.0).alias("mono"))
    counts = {r.clip_id: r._n for r in frame_counts(mono, 16).collect()}
    frames = {r.clip_id: r["count"] for r in frame_table(mono, 32, 16).groupBy("clip_id").count().collect()}
    assert all(frames[k] <= n <= frames[k] + 2 for k, n in counts.items())
    usual, sliced = (_rows(envelope_features(mono, 1000, size=32, hop=16, limit=n)) for n in (10**6, 50))
    assert len(usual) == 2 and all(_same(a, b) for x, y in zip(usual, sliced) for a, b in zip(x, y))
