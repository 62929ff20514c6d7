"""Files over splits, documents in parallel, replaced results, files by content, and a cache that stays where it is."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from earmark import constants as C
from earmark.operators.incremental import append_cache, merge_scores, read_cache, split_cached
from earmark.plans.catalog import inputs
from earmark.session import scratch_path, small_splits
from earmark.sources import files


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 97) if i % 5 else "" for i in range(4_000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("only\n\nthree")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with small_splits(spark, 8_192):
        read = files.read_numbered_lines(spark, str(tmp_path))
        blocks = spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        rows = read.collect()
    assert blocks > 10 and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    for name, want in (("a.txt", lines), ("b.txt", ["only", "", "three"])):
        own = sorted((r.line_no, r.line) for r in rows if r.file.endswith(name))
        assert own == list(enumerate(want))


def _sample(i):
    return {
        "sample_id": f"s{i}", "dataset": "set_a", "split": "evaluation", "audio_path": f"{i}.mp3", "source_url": "a}, {b",
        "source_license": None, "targets": {k: (None, True, False)[(i + n) % 3] for n, k in enumerate(C.TARGET_LABELS)},
        "source_tags": ["x", "    {", "},"], "sha256": "0" * 64, "group_id": None if i % 2 else "g",
    }


@pytest.mark.parametrize("n", [0, 1, 700])
def test_one_document_is_read_by_many_tasks(spark, tmp_path, n):
    document = {"version": {"format": 1}, "samples": [_sample(i) for i in range(n)], "counts": {"a": {"b": 1}}}
    (tmp_path / "manifest.json").write_text(json.dumps(document, indent=2))
    whole = files.read_manifest(spark, str(tmp_path))
    with small_splits(spark, 16_384):
        got = files.read_manifest_document(spark, str(tmp_path))
        if n > 100:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        rows = sorted(map(str, got.select(*whole.columns).collect()))
    assert rows == sorted(map(str, whole.collect())) and len(rows) == n


def test_documents_of_a_dataset_are_bounded(spark, tmp_path, monkeypatch):
    """One dataset of many samples is several documents, each of about the given number, and no sample is lost."""
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("src").alias("source"), F.lit("en").alias("lang"), F.lit("x").alias("text"))
    rows.write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(inputs, "DOCUMENT_SAMPLES", 100, raising=False)
    monkeypatch.setattr(inputs, "scratch_path", lambda spark, name: f"{tmp_path}/out")
    got = inputs.manifest_document_query(spark, f"{tmp_path}/in").select("sample_id").distinct().count()
    sizes = [f.read_text().count('"sample_id"') for f in (tmp_path / "out").rglob("*.txt")]
    assert got == sum(sizes) == 900 and len(sizes) == 9 and max(sizes) <= 200


def test_a_document_with_other_labels_is_refused(spark, tmp_path):
    bad = _sample(1) | {"targets": {"drums": True}}
    (tmp_path / "manifest.json").write_text(json.dumps({"samples": [_sample(0), bad]}, indent=2))
    with pytest.raises(Exception, match="exactly the target labels"):
        files.read_manifest_document(spark, str(tmp_path)).collect()


def test_results_are_replaced_one_by_one(spark):
    path = scratch_path(spark, "test-results")
    schema = files.RESULT
    part = ("piano", "Piano", "candidate", 0.5, [(0.0, 1.0, 0.9, 0.8)])
    first = spark.createDataFrame([(a, "1.0.0", [part]) for a in ("a", "b/c", "d=1", "7")], schema)
    files.replace_results(first, path)
    files.replace_results(spark.createDataFrame([("b/c", "1.0.0", [("bass", "Bass", "unknown", 0.1, [])]), ("new", "1.0.0", [])], schema), path)
    got = {r.analysis_id: r for r in files.read_results(spark, path).collect()}
    assert set(got) == {"a", "b/c", "d=1", "7", "new"} and got["new"].instruments == []
    assert [i.canonical_label for i in got["b/c"].instruments] == ["bass"] and got["b/c"].instruments[0].time_ranges == []
    assert got["a"].instruments[0].time_ranges[0].peak_score == 0.9
    files.replace_results(first.limit(0), path)
    assert files.read_results(spark, path).count() == 5


def test_replacing_many_results_writes_no_folder_each(spark, tmp_path):
    path = f"{tmp_path}/results"
    documents = spark.range(0, 600, 1, 3).select(
        F.when(F.col("id") > 1, F.col("id").cast("string")).when(F.col("id") == 1, "").alias("analysis_id"), F.lit("1.0.0").alias("schema_version"),
        F.array().cast(files.RESULT.split("instruments ")[1]).alias("instruments"),
    )  # a null and an empty name among them
    newer = documents.withColumn("schema_version", F.lit("2.0.0"))
    files.replace_results(documents, path)
    for some in (newer.filter("try_cast(analysis_id as int) % 3 = 0"), newer.limit(0), newer.filter("analysis_id is null or analysis_id = ''")):
        files.replace_results(some, path)
    got = [(r.analysis_id, r.schema_version) for r in files.read_results(spark, path).collect()]
    names = [None, "", *map(str, range(2, 600))]
    assert dict(got) == {n: "2.0.0" if not n or int(n) % 3 == 0 else "1.0.0" for n in names} and len(got) == 600
    assert len(list((tmp_path / "results").rglob("*.json"))) <= 12


def test_changed_and_missing_files_are_reported(spark, tmp_path):
    """The reader lists no file without bytes, so an empty one counts as missing."""
    (tmp_path / "deep").mkdir()
    bodies = {"same": b"abc", "changed": b"abd", "deep/other": b"xyz", "empty": b""}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    found = files.read_inventory(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", f"^.*{tmp_path}/", ""))
    digest = {name: hashlib.sha256(b"abc" if name == "changed" else body).hexdigest() for name, body in bodies.items()}
    manifest = spark.createDataFrame([*digest.items(), ("gone", "0" * 64), ("none", None)], "path string, sha256 string")
    errors = {r.path: r.error for r in files.integrity_check(found, manifest).collect()}
    assert errors == {"same": None, "changed": "integrity_failure", "deep/other": None, "empty": "integrity_failure", "gone": "integrity_failure", "none": None}


def test_many_texts_are_checked_without_a_folder_each(spark, tmp_path, monkeypatch):
    """Null languages and texts keep their row, and the files written are as many as tasks, not as texts."""
    rows = [(i, "text " * (i % 3), ("en", "de", "fr", None)[i % 4]) for i in range(400)] + [(400, None, "en"), (401, None, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(inputs, "scratch_path", lambda spark, name: f"{tmp_path}/out")
    got = {r.path: r.error for r in inputs.file_integrity_query(spark, f"{tmp_path}/in").collect()}
    assert got == {str(i): "integrity_failure" if lang in ("de", "fr") else None for i, _, lang in rows}
    assert len([f for f in (tmp_path / "out").rglob("*") if f.suffix == ".parquet"]) <= 4


def _above_scan(df, path):
    """Operators between the scan of a folder and the first join above it, that join included."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*(0123456789)")) for x in lines]
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and path.rsplit("/", 1)[-1][:20] in x)
    found, level = [], depth[at]
    for i in range(at - 1, -1, -1):
        if lines[i].index(lines[i].lstrip(" :+-")[0]) < lines[at].index(lines[at].lstrip(" :+-")[0]) and depth[i] < level:
            found.append(lines[i])
            level = depth[i]
            if "Join" in lines[i]:
                break
    return found


def test_the_cache_is_joined_where_it_lies(spark):
    table, path = f"cache_{uuid.uuid4().hex}", scratch_path(spark, "test-cache")
    required = spark.range(400).select(
        (F.col("id") % 100).cast("string").alias("sample_id"), F.floor(F.col("id") / 100).cast("string").alias("label"), F.lit(1).alias("target")
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        append_cache(required.filter("sample_id < 50").withColumn("score", F.lit(0.25)), table, path, buckets=4)
        for run in (1, 2):  # the first finds a half, the second everything
            cached, todo = split_cached(required, read_cache(spark, table))
            assert (cached.count(), todo.count()) == ((200, 200) if run == 1 else (400, 0))
            above = _above_scan(cached, path)
            assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above)
            append_cache(todo.withColumn("score", F.lit(0.75)), table, path, buckets=4)
        scores = merge_scores(cached.select("sample_id", "score"), todo.select("sample_id", F.lit(None).cast("double").alias("score")))
        assert scores.groupBy("score").count().orderBy("score").collect() == [(0.25, 200), (0.75, 200)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
