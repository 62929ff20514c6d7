"""Quota sampling and file formats."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from earmark import constants as C
from earmark.operators.sampling import (
    assert_no_leak,
    greedy_partial_sample,
    late_fetch,
    quota_sample,
    quota_shortfalls,
    require_quota,
    second_split,
)
from earmark.sources import files

POOL = "sample_id int, label string, target boolean"


def scan(rows, quota):
    """The sequential rule, written plainly."""
    counts, kept = {}, set()
    for i, judged in enumerate(rows):
        pairs = [(label, t) for label, t in judged.items() if t is not None]
        if any(counts.get(p, 0) < quota for p in pairs):
            kept.add(i)
            for p in pairs:
                counts[p] = counts.get(p, 0) + 1
    return kept


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.fixed_dictionaries({k: st.sampled_from([True, False, None]) for k in "abc"}), min_size=1, max_size=40), st.integers(1, 4))
def test_greedy_scan_equals_the_rank_rule(spark, rows, quota):
    df = spark.createDataFrame([(i, k, t) for i, r in enumerate(rows) for k, t in r.items()], POOL)
    got = {r.sample_id for r in greedy_partial_sample(df, quota, []).collect()}
    assert got == scan(rows, quota)


def test_two_splits_are_disjoint_and_shortfalls_are_reported(spark):
    rows = [(i, label, (i + k) % 3 == 0) for i in range(30) for k, label in enumerate("ab")]
    pool = spark.createDataFrame(rows, POOL)
    first = quota_sample(pool, 4, [])
    assert first.groupBy("label", "target").count().filter("count <> 4").isEmpty()
    second = second_split(pool, first, 8, [])
    assert first.join(second, "sample_id", "left_semi").isEmpty()
    short = {(r.label, r.target): r.drawn for r in quota_shortfalls(second, list("ab"), 8).collect()}
    assert short and all(t for _, t in short)
    require_quota(second, list("ab"), 8, tolerate_positive=True)
    with pytest.raises(RuntimeError, match="not enough records"):
        require_quota(second, list("abz"), 8, tolerate_positive=True)


def test_leaks_are_refused(spark):
    df = spark.createDataFrame([("g", "calibration"), ("h", "evaluation")], "group_id string, split string")
    assert assert_no_leak(df) is df
    with pytest.raises(RuntimeError):
        assert_no_leak(df.union(spark.createDataFrame([("g", "evaluation")], df.schema)))


def test_late_fetch_reads_payload_of_chosen_rows(spark):
    wide = spark.range(10).select(F.col("id").alias("sample_id"), F.col("id").cast("string").alias("payload"))
    got = late_fetch(wide.filter("sample_id in (2, 5)").select("sample_id"), wide, "sample_id", ["payload"])
    assert sorted(r.payload for r in got.collect()) == ["2", "5"]


def test_scores_round_trip_and_malformed_rows_fail(spark, tmp_path):
    df = spark.createDataFrame([("bass", 1, 0.1234567890123), ("a,b", 0, 1e-9)], files.LABELLED)
    files.write_scores_csv(df, f"{tmp_path}/s")
    assert sorted(map(tuple, files.read_scores_csv(spark, f"{tmp_path}/s").collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "bad.csv").write_text("label,target,model_score\nbass,one,0.5\n")
    with pytest.raises(Exception):
        files.read_scores_csv(spark, f"{tmp_path}/bad.csv").collect()


def test_tracks_and_licenses(spark, tmp_path):
    (tmp_path / "t.tsv").write_text(
        "TRACK_ID\tARTIST_ID\tALBUM_ID\tPATH\tDURATION\tTAGS\n"
        "track_0000042\ta\tb\t42.mp3\t12.5\tinstrument---bass,instrument---piano\n"
        "track_7\ta\tb\t7.mp3\t3\tinstrument---violin\n")
    rows = {r.numeric_id: r for r in files.read_tracks_tsv(spark, f"{tmp_path}/t.tsv").collect()}
    assert rows[42].tags == ["bass", "piano"] and rows[42].duration_s == 12.5 and rows[7].path == "7.mp3"
    (tmp_path / "l.txt").write_text("42.mp3\n\nfirst\n42.mp3\n\nsecond\n7.mp3\n")
    found = files.line_offset_lookup(files.read_numbered_lines(spark, f"{tmp_path}/l.txt"), ".mp3")
    assert {r.line: r.value for r in found.collect()} == {"42.mp3": "second"}
    tracks = files.read_tracks_tsv(spark, f"{tmp_path}/t.tsv")
    licensed = {r.numeric_id: r.license for r in files.with_license(tracks, found).collect()}
    assert licensed == {42: "second", 7: C.MISSING_LICENSE}


def record(sample_id, targets, **more):
    return {"sample_id": sample_id, "dataset": "d", "split": "evaluation", "audio_path": "p", "source_url": "u", "source_license": "l",
            "targets": targets, "source_tags": ["t"], "sha256": "0", **more}


def test_manifest_document_and_lines(spark, tmp_path):
    targets = {label: None for label in C.TARGET_LABELS} | {"bass": True, "piano": False}
    (tmp_path / "m.json").write_text(json.dumps({"seed": 1, "samples": [record("s1", targets), record("s2", targets, group_id="g")]}))
    manifest = files.read_manifest(spark, f"{tmp_path}/m.json")
    assert {r.sample_id: r.group_id for r in manifest.collect()} == {"s1": "s1", "s2": "g"}
    long = {(r.sample_id, r.label): r.target for r in files.targets_long(manifest).collect()}
    assert long == {("s1", "bass"): 1, ("s1", "piano"): 0, ("s2", "bass"): 1, ("s2", "piano"): 0}
    files.write_manifest(manifest, f"{tmp_path}/lines")
    again = files.read_manifest(spark, f"{tmp_path}/lines", lines=True)
    assert {r.sample_id: len(r.targets) for r in again.collect()} == {"s1": 10, "s2": 10}
    (tmp_path / "bad.json").write_text(json.dumps({"samples": [record("s3", {"bass": True})]}))
    with pytest.raises(Exception, match="exactly the target labels"):
        files.read_manifest(spark, f"{tmp_path}/bad.json").collect()


def test_results_round_trip_and_export(spark, tmp_path):
    bass = ("a", "bass", "贝斯", "confirmed", 0.5)
    rows = [(*bass, 4.0, 5.125, 0.9, 0.8), (*bass, 0.0, 2.5, 0.7, 0.6), ("a", "pad", "Pad", "unknown", 0.125, None, None, None, None)]
    activity = spark.createDataFrame(rows, "clip_id string, canonical_label string, display_name string, decision string, score double, "
                                     "start_s double, end_s double, peak_score double, confidence double")
    files.write_results(files.nest_results(activity), f"{tmp_path}/r")
    flat = {r.canonical_label: r for r in files.flatten_results(files.read_results(spark, f"{tmp_path}/r")).collect()}
    assert flat["bass"].time_ranges == "0.00-2.50; 4.00-5.12" and flat["bass"].model_score == "0.500000"
    assert flat["pad"].time_ranges == "" and flat["pad"].display_name == "Pad"
    straight = files.export_rows(files.label_results(activity))
    assert {r.canonical_label: r for r in straight.collect()} == flat
    assert straight._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1


def test_lines_are_numbered_across_splits(spark, tmp_path):
    text = [f"line {i}" if i % 7 else "" for i in range(400)]
    (tmp_path / "long.txt").write_text("\n".join(text) + "\n")
    sizes = {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        assert spark.read.text(f"{tmp_path}/long.txt").rdd.getNumPartitions() > 3
        got = files.read_numbered_lines(spark, f"{tmp_path}/long.txt").orderBy("line_no").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.line_no for r in got] == list(range(400)) and [r.line for r in got] == text


def test_inventory_and_integrity(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(b"abc")
    inventory = files.read_inventory(spark, f"{tmp_path}/in")
    row = inventory.first()
    assert (row.sha256, row.size_bytes) == (hashlib.sha256(b"abc").hexdigest(), 3)
    manifest = spark.createDataFrame([(row.path, row.sha256), (row.path + "?", row.sha256)], "path string, sha256 string")
    got = {r.path: r.error for r in files.integrity_check(inventory, manifest).collect()}
    assert got == {row.path: None, row.path + "?": "integrity_failure"}
    other = manifest.withColumn("sha256", F.lit("0"))
    assert files.integrity_check(inventory, other).filter("error is null").isEmpty()
