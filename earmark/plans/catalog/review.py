"""Review analytics, overrides, event validation and the streaming counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark.operators.review import (
    append_overrides,
    effective_values,
    outcome_pivot,
    review_rates,
    time_savings,
    validate_review_events,
)
from earmark.plans import adapters as A
from earmark.plans.adapters import with_inputs
from earmark.plans.catalog.registry import register, tidied, tidy
from earmark.session import scratch_path
from earmark.streaming.common import drain
from earmark.streaming.review_stream import outcome_counts

_RATE_NAMES = ("confirmed_accept_rate", "candidate_accept_rate", "usable_after_edit_rate", "missing_rate",
               "wrong_confirmed_rate", "prefill_rate")


@register("review_rates", tidied(with_inputs(["review_events"], """
    SELECT count(*) AS n_events,
           count_if(decision = 'confirmed' AND outcome = 'accept_as_is') / nullif(count_if(decision = 'confirmed'), 0) AS confirmed_accept_rate,
           count_if(decision = 'candidate' AND outcome = 'accept_as_is') / nullif(count_if(decision = 'candidate'), 0) AS candidate_accept_rate,
           count_if(outcome = 'accept_after_edit') / nullif(count(*), 0) AS usable_after_edit_rate,
           count_if(outcome = 'missing_label') / nullif(count(*), 0) AS missing_rate,
           count_if(decision = 'confirmed' AND outcome = 'reject') / nullif(count_if(decision = 'confirmed'), 0) AS wrong_confirmed_rate,
           count_if(decision IN ('confirmed', 'candidate')) / nullif(count(*), 0) AS prefill_rate
    FROM review_events"""), *_RATE_NAMES))
def review_rates_query(spark, d):
    return tidy(review_rates(A.review_events(spark, d)))


_PIVOT = """
    count_if(outcome = 'accept_as_is')::BIGINT AS accept_as_is, count_if(outcome = 'accept_after_edit')::BIGINT AS accept_after_edit,
    count_if(outcome = 'reject')::BIGINT AS reject, count_if(outcome = 'missing_label')::BIGINT AS missing_label,
    count_if(outcome = 'uncertain')::BIGINT AS uncertain FROM review_events GROUP BY 1"""


@register("outcomes_by_label", with_inputs(["review_events"], f"SELECT coalesce(label, 'global') AS label, {_PIVOT}"))
def pivot_label_query(spark, d):
    return outcome_pivot(A.review_events(spark, d), "label")


@register("outcomes_by_field", with_inputs(["review_events"], f"SELECT coalesce(field_name, field_id) AS field, {_PIVOT}"))
def pivot_field_query(spark, d):
    return outcome_pivot(A.review_events(spark, d), "field")


_SAVINGS = ("median_saving", "median_review_s", "mean_saving", "mean_review_s", "mean_model_s")


@register("time_savings", tidied(with_inputs(["review_sessions"], """
    SELECT count(*) AS n_sessions, count(saving) AS n_timed, avg(saving) AS mean_saving, median(saving) AS median_saving,
           avg(total_review_s) AS mean_review_s, median(total_review_s) AS median_review_s, avg(model_s) AS mean_model_s
    FROM (SELECT *, CASE WHEN baseline_s > 0 THEN 1 - total_review_s / baseline_s END AS saving FROM review_sessions)"""), *_SAVINGS))
def time_savings_query(spark, d):
    return tidy(time_savings(A.review_sessions(spark, d)))


@register("effective_values", """
    WITH p AS (SELECT user_id AS analysis_id, 'instruments.' || k || '.decision' AS field_path, min(event_type) AS value
               FROM events, (SELECT unnest(range(0, 6)) AS k) GROUP BY ALL),
         o AS (SELECT user_id AS analysis_id, 'instruments.' || (event_id % 5) || '.decision' AS field_path,
                      arg_max(CASE WHEN event_type <> 'error' THEN event_type ELSE '' END, event_id) AS latest, count(*) AS n
               FROM events GROUP BY ALL)
    SELECT p.analysis_id, p.field_path, p.value, CASE WHEN o.n IS NULL THEN p.value ELSE nullif(o.latest, '') END AS effective_value,
           coalesce(o.n, 0) AS n_overrides FROM p LEFT JOIN o USING (analysis_id, field_path)""")
def effective_query(spark, d):
    """Overrides go through their append-only log first."""
    path = scratch_path(spark, "overrides")
    append_overrides(A.overrides(spark, d), path)
    return effective_values(A.field_values(spark, d), spark.read.parquet(path))


@register("recordable_review_events", tidied(with_inputs(["review_events"], """
    SELECT session_id, seq, field_id, outcome, elapsed_s FROM review_events WHERE elapsed_s >= 0 AND profile IS NOT NULL"""), "elapsed_s"))
def recordable_query(spark, d):
    good, _ = validate_review_events(A.review_events(spark, d))
    return tidy(good.select("session_id", "seq", "field_id", "outcome", "elapsed_s"))


@register("rejected_review_events", with_inputs(["review_events"], """
    SELECT session_id, seq, CASE WHEN elapsed_s < 0 THEN 'negative_elapsed' ELSE 'profile_missing' END AS reason
    FROM review_events WHERE elapsed_s < 0 OR profile IS NULL"""))
def rejected_query(spark, d):
    _, bad = validate_review_events(A.review_events(spark, d))
    return bad.select("session_id", "seq", "reason")


@register("streamed_outcome_counts", with_inputs(["review_events"], """
    SELECT * FROM (
        SELECT (epoch_us(ts) - 1704067200000000) // 86400000000 * 86400 AS window_start,
               ((epoch_us(ts) - 1704067200000000) // 86400000000 + 1) * 86400 AS window_end, outcome,
               count(*) AS n_events FROM review_events GROUP BY ALL)
    WHERE window_end <= (SELECT (epoch_us(max(ts)) - 1704067200000000) / 1000000 - 3600 FROM events)"""))
def streamed_counts_query(spark, d):
    """A bounded replay in append mode: the windows that the final watermark has closed."""
    source = spark.readStream.schema(A.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    events = source.select(A.event_time().alias("event_time"), A.outcome().alias("outcome"))
    return drain(outcome_counts(events), "outcomes")
