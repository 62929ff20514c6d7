"""Streams against batch, plan shapes, and all registered queries against their SQL."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from earmark.plans import adapters as A
from earmark.streaming.common import drain
from earmark.streaming.interval_stream import live_intervals
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
LIVE = (
    "clip_id long, canonical_label string, window_idx long, start_s double, end_s double, score double, event_time timestamp, "
    "threshold double, release_ratio double, gap_s double, min_duration_s double, min_windows int"
)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_live_intervals_over_several_triggers(spark, tmp_path):
    series = [(0, 2, 0.7), (2, 4, 0.4), (4, 6, 0.1), (30, 32, 0.8), (33, 35, 0.9), (5, 6, 0.9), (90, 91, 0.1)]
    for batch, windows in enumerate((series[:2], series[2:4], series[4:])):
        rows = [(1, "x", i, float(a), float(b), s, 0.6, 0.5, 2.0, 1.0, 1) for i, (a, b, s) in enumerate(windows, 10 * batch)]
        df = spark.createDataFrame(rows, LIVE.replace("event_time timestamp, ", ""))
        df.withColumn("event_time", F.timestamp_millis((F.col("start_s") * 1000).cast("long") + 1_700_000_000_000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(LIVE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted((r.start_s, r.end_s, r.n_windows) for r in drain(live_intervals(source, delay="0 seconds"), "live").collect())
    # the late window at 5 s is dropped; the last interval is closed by the watermark
    assert got == [(0.0, 4.0, 2), (30.0, 35.0, 2)]


def test_live_intervals_forget_idle_clips(spark, tmp_path):
    series = [[(1, 0, 0.1), (2, 0, 0.9), (2, 2, 0.1)], [(3, 100, 0.1)], [(1, 200, 0.9), (4, 200, 0.1)], [(5, 400, 0.9)]]
    for batch, windows in enumerate(series):
        rows = [(c, "x", i, float(a), a + 2.0, s, 0.6, 0.5, 2.0, 1.0, 1) for i, (c, a, s) in enumerate(windows, 10 * batch)]
        df = spark.createDataFrame(rows, LIVE.replace("event_time timestamp, ", ""))
        df.withColumn("event_time", F.timestamp_millis((F.col("start_s") * 1000).cast("long") + 1_700_000_000_000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(LIVE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = (
        live_intervals(source, delay="0 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted((r.clip_id, r.start_s, r.end_s) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # clip 1 starts anew after it was forgotten; clip 5 is still open
    assert got == [(1, 200.0, 202.0), (2, 0.0, 2.0)]
    # clips 2, 3 and 4 are off and gone; clip 1 is on, clip 5 open
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 2


def test_live_intervals_share_state_rows(spark, tmp_path):
    """Clips of one slot keep apart over triggers, ids above 2 ** 53 and a missing one among them."""
    clips = [None, 0, 1, 2**60, 2**60 + 1, *range(10, 60)]
    for batch, (start, score) in enumerate(((0, 0.9), (2, 0.4), (50, 0.9), (200, 0.1))):
        rows = [(c, "xy"[i % 2], batch, start + 0.0, start + 2.0, score, 0.6, 0.5, 2.0, 1.0, 1) for i, c in enumerate(clips)]
        df = spark.createDataFrame(rows, LIVE.replace("event_time timestamp, ", ""))
        df.withColumn("event_time", F.timestamp_millis((F.col("start_s") * 1000).cast("long") + 1_700_000_000_000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(LIVE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = (
        live_intervals(source, delay="0 seconds", slots=3).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.clip_id, r.canonical_label, r.start_s, r.end_s, r.n_windows) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(c, "xy"[i % 2], *x) for i, c in enumerate(clips) for x in ((0.0, 4.0, 2), (50.0, 52.0, 1))}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3


def test_no_python_outside_the_plug_ins(spark):
    python = {"apply_scorer", "live_intervals"}
    for name in ("label_activity", "label_activity_dense", "average_precision", "coverage_cube", "holdout_validation",
                 "classify_spatial", "envelope_features", "spectral_features", "quota_sample", "expand_form"):
        assert name not in python
        text = plan(queries()[name](spark, SMALL))
        assert "Python" not in text and "MapInPandas" not in text, name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_quota_rank_is_cut_before_the_shuffle(spark):
    text = plan(queries()["quota_sample"](spark, SMALL))
    assert text.count("WindowGroupLimit") == 2


def test_scans_are_pruned_and_filters_pushed(spark):
    text = plan(A.predictions(spark, SMALL).groupBy("label").count())
    assert "ReadSchema: struct<l_partkey:bigint>" in text
    text = plan(queries()["late_fetch"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint>" in text and "lang" not in text


def test_usual_intervals_take_one_shuffle_of_the_windows(spark):
    canonical = A.frame_scores(spark, SMALL).withColumnRenamed("raw_label", "canonical_label")
    from earmark.operators.intervals import activity_intervals

    rules = {"threshold": 0.3, "release_ratio": 0.8, "gap_s": 2.0, "min_duration_s": 1.0, "min_windows": 1}
    for name, value in rules.items():
        canonical = canonical.withColumn(name, F.lit(value))
    assert plan(activity_intervals(canonical)).count("Exchange hashpartitioning") == 1


def test_statistics_and_intervals_share_one_scan_and_shuffle(spark):
    df = queries()["label_activity"](spark, SMALL)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert text.count("FileScan") == 1 and "ReusedExchange [clip_id" in text


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "decision" in df.columns


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, name):
    sql = oracle_sql().get(name)
    if sql is None:
        queries()[name](spark, SMALL).collect()
        return
    difference, _, _ = compare(spark, duck, queries()[name], sql, SMALL)
    assert difference is None, difference
