"""Dedupe, patch folding, score-cache deltas, scorer plug-in, failures and live intervals."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from earmark.operators.incremental import (
    append_cache,
    dedupe_submissions,
    fold_task_patches,
    merge_scores,
    read_cache,
    split_cached,
    task_key,
)
from earmark.operators.quality import with_failures
from earmark.operators.scoring import apply_scorer, linear_head
from earmark.plans import adapters as A
from earmark.plans.activity import with_rules
from earmark.plans.adapters import with_inputs
from earmark.plans.catalog.registry import register, tidied, tidy
from earmark.plans.catalog.scores import EVENTS, interval_parts, score_parts
from earmark.session import scratch_path
from earmark.streaming.common import drain
from earmark.streaming.interval_stream import live_intervals

_KEYED = """
    SELECT *, substr(sha256(concat_ws(':', sha, profile, separation)), 1, 16) AS task_id FROM submissions"""


@register("dedupe_submissions", with_inputs(["submissions"], """
    SELECT seq, task_id, CASE WHEN task_id IN (SELECT task_id FROM known) THEN 'cached'
                              WHEN row_number() OVER (PARTITION BY task_id ORDER BY seq) = 1 THEN 'queued' ELSE 'cached' END AS status
    FROM keyed""", keyed=_KEYED, known="SELECT task_id FROM keyed WHERE lang = 'de'"))
def dedupe_query(spark, d):
    """The German documents have been analysed before."""
    subs = A.submissions(spark, d)
    existing = subs.filter(F.col("lang") == "de").select(
        task_key(F.col("sha"), F.col("profile"), F.col("separation")).alias("task_id")
    )
    return dedupe_submissions(subs.drop("lang"), existing)


@register("fold_task_patches", tidied("""
    SELECT user_id AS analysis_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS progress,
           arg_max(props, event_id) FILTER (event_type = 'error') AS error,
           arg_max(props, event_id) FILTER (event_type = 'purchase') AS file_sha256, count(*) AS n_patches
    FROM events GROUP BY user_id""", "progress"))
def fold_query(spark, d):
    return tidy(fold_task_patches(A.task_patches(spark, d)))


_CACHE = "SELECT sample_id, label, score FROM required WHERE score > 0.2::DOUBLE AND (label = 'bass' OR dataset <> 'fr')"
_REQUIRED = "SELECT * FROM doc_predictions WHERE target IS NOT NULL"
_CACHED = """
    SELECT * FROM required WHERE sample_id NOT IN (
        SELECT r.sample_id FROM required r LEFT JOIN cache c USING (sample_id, label) WHERE c.score IS NULL)"""
_SPLIT_PARTS = {"required": _REQUIRED, "cache": _CACHE, "cached": _CACHED}


def _split(spark, d):
    required = A.doc_predictions(spark, d).filter(F.col("target").isNotNull())
    kept = (F.col("score") > 0.2) & ((F.col("label") == "bass") | (F.col("dataset") != "fr"))
    cache = required.filter(kept).select("sample_id", "label", "score")
    return required, split_cached(required.drop("score"), cache)


@register("split_cached", with_inputs(["doc_predictions"], """
    SELECT sample_id, label, CASE WHEN sample_id IN (SELECT sample_id FROM cached) THEN 'cached' ELSE 'to_score' END AS part FROM required""",
    **_SPLIT_PARTS))
def split_query(spark, d):
    _, (cached, todo) = _split(spark, d)
    rows = cached.select("sample_id", "label", F.lit("cached").alias("part"))
    return rows.unionByName(todo.select("sample_id", "label", F.lit("to_score").alias("part")))


@register("merged_scores", tidied(with_inputs(["doc_predictions"], """
    SELECT sample_id, label, target, CASE WHEN sample_id IN (SELECT sample_id FROM cached) THEN score ELSE 0.5::DOUBLE END AS score FROM required""",
    **_SPLIT_PARTS), "score"))
def merged_query(spark, d):
    _, (cached, todo) = _split(spark, d)
    columns = ["sample_id", "label", "target", "score"]
    return tidy(merge_scores(cached.select(columns), todo.withColumn("score", F.lit(0.5)).select(columns)))


@register("cached_runs", tidied(with_inputs(["doc_predictions"], """
    SELECT sample_id, label, target, CASE WHEN dataset <> 'fr' THEN score ELSE 0.5::DOUBLE END AS score FROM required""",
    required=_REQUIRED), "score"))
def cached_runs_query(spark, d):
    """Two runs over one bucketed cache: the first scores all but the French samples, the second finds those cached."""
    table, path = f"score_cache_{uuid.uuid4().hex}", scratch_path(spark, "score-cache")
    required = A.doc_predictions(spark, d).filter(F.col("target").isNotNull())
    append_cache(required.filter(F.col("dataset") != "fr"), table, path)
    cached, todo = split_cached(required.drop("score"), read_cache(spark, table))
    append_cache(todo.withColumn("score", F.lit(0.5)), table, path)
    cached, todo = split_cached(required.drop("score"), read_cache(spark, table))
    columns = ["sample_id", "label", "target", "score"]
    return tidy(merge_scores(cached.select(columns), todo.withColumn("score", F.lit(None).cast("double")).select(columns)))


def _weights(width: int) -> list[float]:
    return [((k * 7) % 11 - 5) / 4 for k in range(width)]


HEAD_LABELS = ("bright", "dark")


def _load_head():
    """A small linear head, built once per task."""
    weights = np.array([_weights(64), [-w for w in _weights(64)]]).T

    def score(batch: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(batch @ weights + 0.1)))

    return score


_DOT = "list_sum(list_transform(range(1, 65), lambda k: embedding[k]::DOUBLE * (((k - 1) * 7) % 11 - 5) / 4.0::DOUBLE))"


@register("apply_scorer", tidied(f"""
    SELECT vec_id, 1 / (1 + exp(-({_DOT} + 0.1::DOUBLE))) AS bright, 1 / (1 + exp(-(-({_DOT}) + 0.1::DOUBLE))) AS dark FROM embeddings""",
    "bright", "dark"))
def scorer_query(spark, d):
    scored = apply_scorer(A.table(spark, d, "embeddings"), _load_head, HEAD_LABELS, keep=["vec_id"])
    return tidy(scored.select("vec_id", *[F.get("scores", F.lit(i)).alias(n) for i, n in enumerate(HEAD_LABELS)]))


@register("linear_head", tidied(f"SELECT vec_id, 1 / (1 + exp(-({_DOT} + 0.1::DOUBLE))) AS bright FROM embeddings", "bright"))
def head_query(spark, d):
    vector = F.transform("embedding", lambda x: x.cast("double"))
    return tidy(A.table(spark, d, "embeddings").select("vec_id", linear_head(vector, _weights(64), 0.1).alias("bright")))


@register("captured_failures", """
    SELECT event_id, CASE WHEN value > 200 THEN 'too_large' ELSE 'props_out_of_range' END AS error FROM events
    WHERE value > 200 OR (props->>'k')::INT >= 90""")
def failures_query(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    reason = F.when(F.col("value") > 200, "too_large").when(k.isNull() | (k >= 90), "props_out_of_range")
    _, failed = with_failures(A.table(spark, d, "events"), reason)
    return failed.select("event_id", "error")


@register("live_intervals", tidied(with_inputs(EVENTS, """
    SELECT i.clip_id, i.canonical_label, i.start_s, i.end_s, i.peak_score, i.confidence, i.n_windows
    FROM intervals i JOIN rules r USING (canonical_label)
    WHERE EXISTS (SELECT 1 FROM ranges x WHERE x.clip_id = i.clip_id AND x.canonical_label = i.canonical_label AND x.start_s > i.end_s)
       OR floor((i.end_s + r.gap_s) * 3600000) < (SELECT floor((epoch_us(max(ts)) - 1704067200000000) / 1000) - 3600000 FROM events)""",
    **score_parts("frame_scores"), **interval_parts()), "start_s", "end_s", "peak_score", "confidence"))
def live_intervals_query(spark, d):
    """A bounded replay: intervals closed by a later one or by the final watermark."""
    schema = A.table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ruled = with_rules(A.streamed_scores(source), "calibrated_public_v1")
    return tidy(drain(live_intervals(ruled, second_ms=3_600_000), "intervals"))
