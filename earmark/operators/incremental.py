"""Incremental processing: content-addressed dedupe, patch folding and score-cache deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def task_key(sha: Column, profile: Column, separation: Column) -> Column:
    """First 16 hex digits of the digest of ``sha:profile:0/1``."""
    text = F.concat_ws(":", sha, profile, separation.cast("int").cast("string"))
    return F.substring(F.sha2(text, 256), 1, 16)


def dedupe_submissions(submissions: DataFrame, existing: DataFrame) -> DataFrame:
    """Status per submission: ``queued`` for the first of a new key, else ``cached``.

    Submissions: seq (unique), sha, profile, separation. The first one per key is found by a
    combining minimum and matched back on the unique seq, so a third of all rows being copies of
    one file loads no single task. ``existing``: task_id.
    """
    keyed = submissions.withColumn("task_id", task_key(F.col("sha"), F.col("profile"), F.col("separation")))
    known = existing.select("task_id").distinct().withColumn("_known", F.lit(True))
    fresh = (
        keyed.groupBy("task_id")
        .agg(F.min("seq").alias("seq"))
        .join(known, "task_id", "left")
        .filter(F.col("_known").isNull())
        .select("seq", F.lit(True).alias("_fresh"))
    )
    return keyed.join(fresh, "seq", "left").select(
        "seq",
        "task_id",
        F.when(F.col("_fresh").isNotNull(), "queued").otherwise("cached").alias("status"),
    )


OVERWRITTEN = ("status", "stage", "progress", "updated_at")
KEPT_WHEN_NULL = ("error", "file_sha256", "result_path", "model_version")


def fold_task_patches(patches: DataFrame) -> DataFrame:
    """Current task rows from a patch log: some columns take the latest patch, others the latest
    non-null value. ``max_by`` combines before the one shuffle."""
    latest = [F.max_by(c, "seq").alias(c) for c in OVERWRITTEN if c in patches.columns]
    kept = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
        for c in KEPT_WHEN_NULL
        if c in patches.columns
    ]
    return patches.groupBy("analysis_id").agg(*latest, *kept, F.count("*").alias("n_patches"))


def split_cached(required: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached rows with scores, rows still to score).

    Required: sample_id, label, one row per judged label. A sample counts as cached only if all
    its labels are; a window holds one sample's labels. Cache: sample_id, label, score, unique.
    """
    found = cache.select("sample_id", "label", F.col("score").alias("_cached"))
    joined = required.join(found, ["sample_id", "label"], "left")
    complete = F.bool_and(F.col("_cached").isNotNull()).over(Window.partitionBy("sample_id"))
    marked = joined.withColumn("_complete", complete)
    cached = marked.filter("_complete").withColumnRenamed("_cached", "score").drop("_complete")
    return cached, marked.filter(~F.col("_complete")).drop("_cached", "_complete")


def merge_scores(cached: DataFrame, scored: DataFrame) -> DataFrame:
    """The full prediction table of a run: cached and newly scored rows."""
    return cached.unionByName(scored)


CACHE_KEYS = ("sample_id", "label")


def append_cache(scores: DataFrame, table: str, path: str, *, buckets: int = 64) -> None:
    """Add (sample_id, label, score) to a score cache: a table bucketed by its keys, in a folder that stays.

    A join with the cache reads its buckets where they lie; only the other side is shuffled.
    """
    rows = scores.select(*CACHE_KEYS, "score").repartition(buckets, *CACHE_KEYS)  # one file per bucket and run
    writer = rows.write.mode("append").format("parquet").bucketBy(buckets, *CACHE_KEYS).sortBy(*CACHE_KEYS)
    writer.option("path", path).saveAsTable(table)


def read_cache(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
