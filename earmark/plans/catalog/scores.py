"""Label mapping, score statistics, decisions, windows and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark import constants as C
from earmark.operators.decisions import decide, demote_ambiguous
from earmark.operators.intervals import hysteresis, merge_gaps, slice_for
from earmark.operators.labels import (
    canonical_scores,
    canonical_scores_dense,
    evidence_map,
    explode_scores,
    fold_partial,
    raw_evidence,
    tags_to_targets,
)
from earmark.operators.scores import KEYS, presence_score, score_statistics, top_fraction_mean
from earmark.operators.windows import cadence_bounds, sliding_windows
from earmark.plans import adapters as A
from earmark.plans.activity import (
    label_activity,
    label_decisions,
    label_intervals,
    small_clips,
    with_rules,
)
from earmark.plans.adapters import profile_sql, rules_sql, with_inputs
from earmark.plans.catalog.registry import register, tidied, tidy

PROFILE = "calibrated_public_v1"
# hours here; short slices so that the stitching between slices is exercised
SLICE_ROWS = 5

CANONICAL = """
    SELECT clip_id, window_idx, canonical_label, min(start_s) AS start_s, min(end_s) AS end_s, max(score) AS score
    FROM {source} JOIN taxonomy USING (raw_label) GROUP BY clip_id, window_idx, canonical_label"""
RANKED = """
    SELECT *, row_number() OVER (PARTITION BY clip_id, canonical_label ORDER BY score DESC) AS rn,
           count(*) OVER (PARTITION BY clip_id, canonical_label) AS n FROM canonical"""
STATS = """
    SELECT clip_id, canonical_label, avg(score) AS mean, quantile_cont(score, 0.5) AS median, max(score) AS max,
           quantile_cont(score, 0.9) AS p90, quantile_cont(score, 0.95) AS p95,
           avg(score) FILTER (rn <= greatest(1, ceil(n * 0.2::DOUBLE))) AS top_mean,
           avg((score >= candidate)::INT) AS active_ratio,
           any_value(candidate) AS candidate, any_value(confirmed) AS confirmed, any_value(auto_confirm) AS auto_confirm
    FROM ranked JOIN profile USING (canonical_label) GROUP BY clip_id, canonical_label"""
DECIDED = """
    SELECT *, CASE WHEN auto_confirm AND score >= confirmed THEN 'confirmed' WHEN score >= candidate THEN 'candidate'
              ELSE 'unknown' END AS decision
    FROM (SELECT *, 0.65::DOUBLE * top_mean + 0.35::DOUBLE * p95 AS score FROM stats)"""
RULED = """
    SELECT c.*, p.candidate AS threshold, r.release_ratio, r.min_duration_s, r.gap_s, r.min_windows
    FROM canonical c JOIN profile p USING (canonical_label) JOIN rules r USING (canonical_label)"""
SWITCHED = """
    SELECT *, coalesce(last_value(CASE WHEN score >= threshold THEN true WHEN score < threshold * release_ratio THEN false END
                         IGNORE NULLS) OVER (PARTITION BY clip_id, canonical_label ORDER BY start_s, window_idx), false) AS is_active
    FROM ruled"""
BEFORE = """
    SELECT *, max(end_s) OVER (PARTITION BY clip_id, canonical_label ORDER BY start_s, window_idx
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest
    FROM switched WHERE is_active"""
ISLANDS = """
    SELECT *, sum((furthest IS NULL OR start_s > furthest + gap_s)::INT) OVER (
                  PARTITION BY clip_id, canonical_label ORDER BY start_s, window_idx ROWS UNBOUNDED PRECEDING) AS island
    FROM before"""
RANGES = """
    SELECT clip_id, canonical_label, min(start_s) AS start_s, max(end_s) AS end_s, max(score) AS peak_score,
           sum(score) AS score_sum, count(*) AS n_windows, any_value(min_duration_s) AS min_duration_s,
           any_value(min_windows) AS min_windows
    FROM islands GROUP BY clip_id, canonical_label, island"""
INTERVALS = """
    SELECT clip_id, canonical_label, start_s, end_s, peak_score, score_sum / n_windows AS confidence, n_windows
    FROM ranges WHERE end_s - start_s >= min_duration_s AND n_windows >= min_windows"""


def score_parts(source: str) -> dict[str, str]:
    return {
        "canonical": CANONICAL.format(source=source),
        "profile": profile_sql(PROFILE),
        "ranked": RANKED,
        "stats": STATS,
        "decided": DECIDED,
    }


def interval_parts() -> dict[str, str]:
    return {
        "rules": rules_sql(),
        "ruled": RULED,
        "switched": SWITCHED,
        "before": BEFORE,
        "islands": ISLANDS,
        "ranges": RANGES,
        "intervals": INTERVALS,
    }


EVENTS = ["frame_scores", "taxonomy"]
VECTORS = ["raw_scores", "taxonomy"]
STATISTICS = ["mean", "median", "max", "p90", "p95", "top_mean", "active_ratio"]


def events_canonical(spark, d):
    return canonical_scores(A.frame_scores(spark, d))


def events_statistics(spark, d):
    """Statistics per clip and label; clip sizes are read off the raw scores, before any shuffle."""
    scores = A.frame_scores(spark, d)
    return score_statistics(canonical_scores(scores), PROFILE, known_small=small_clips(scores))


def events_decisions(spark, d):
    scores = A.frame_scores(spark, d)
    return label_decisions(canonical_scores(scores), PROFILE, known_small=small_clips(scores))


# --- label mapping ---------------------------------------------------------------

_TARGETS = ", ".join(f"('{label}', '{tag}')" for label, tags in C.FULL_TAG_TARGETS.items() for tag in tags)


@register("tags_to_targets", with_inputs(["tag_rows"], f"""
    SELECT id, label, bool_or(coalesce(tag IN (SELECT tag FROM mapping m WHERE m.label = l.label), false)) AS target
    FROM tag_rows, (SELECT DISTINCT label FROM mapping) l GROUP BY id, label""",
    mapping=f"SELECT * FROM (VALUES {_TARGETS}) AS t(label, tag)"))
def tags_to_targets_query(spark, d):
    return tags_to_targets(A.tag_sets(spark, d), key="id", tags="tags")


_MEMBERS = ", ".join(f"('{label}', '{m}')" for label, ms in C.PARTIAL_TARGETS.items() for m in ms)
_LABELS = ", ".join(f"('{label}')" for label in C.TARGET_LABELS)


@register("fold_partial_judgments", with_inputs(["member_judgments"], """
    SELECT d.doc_id, l.label, CASE WHEN bool_or(j.judged) THEN true
           WHEN count(m.member) > 0 AND count(j.judged) = count(m.member) THEN false END AS target
    FROM documents d CROSS JOIN labels_wanted l LEFT JOIN members m ON m.label = l.label
    LEFT JOIN member_judgments j ON j.doc_id = d.doc_id AND j.member = m.member
    GROUP BY d.doc_id, l.label""",
    members=f"SELECT * FROM (VALUES {_MEMBERS}) AS t(label, member)",
    labels_wanted=f"SELECT * FROM (VALUES {_LABELS}) AS t(label)"))
def fold_partial_query(spark, d):
    return fold_partial(A.partial_vectors(spark, d), key="doc_id", values="values", masks="masks")


@register("explode_score_vectors", tidied(with_inputs(["raw_scores"], "SELECT * FROM raw_scores"), "start_s", "end_s", "score"))
def explode_scores_query(spark, d):
    return tidy(explode_scores(A.window_vectors(spark, d), A.RAW))


_CANONICAL_OUT = "SELECT clip_id, window_idx, canonical_label, start_s, end_s, score FROM canonical"


@register("canonical_scores_long", tidied(with_inputs(EVENTS, _CANONICAL_OUT, canonical=CANONICAL.format(source="frame_scores")), "start_s", "end_s", "score"))
def canonical_long_query(spark, d):
    return tidy(events_canonical(spark, d))


@register("canonical_scores_dense", tidied(with_inputs(VECTORS, _CANONICAL_OUT, canonical=CANONICAL.format(source="raw_scores")), "start_s", "end_s", "score"))
def canonical_dense_query(spark, d):
    return tidy(canonical_scores_dense(A.window_vectors(spark, d), A.RAW))


@register("raw_evidence", tidied(with_inputs(VECTORS, """
    SELECT clip_id, canonical_label, raw_label, max(score) AS max_score
    FROM raw_scores JOIN taxonomy USING (raw_label) GROUP BY ALL"""), "max_score"))
def raw_evidence_query(spark, d):
    return tidy(raw_evidence(explode_scores(A.window_vectors(spark, d), A.RAW)))


@register("raw_evidence_map", tidied(with_inputs(VECTORS, """
    SELECT clip_id, canonical_label, count(DISTINCT raw_label) AS n_raw, max(score) AS best
    FROM raw_scores JOIN taxonomy USING (raw_label) GROUP BY ALL"""), "best"))
def evidence_map_query(spark, d):
    nested = evidence_map(raw_evidence(explode_scores(A.window_vectors(spark, d), A.RAW)))
    values = F.map_values("raw_model_scores")
    return tidy(nested.select("clip_id", "canonical_label", F.size(values).cast("long").alias("n_raw"),
                              F.array_max(values).alias("best")))


# --- statistics and decisions ------------------------------------------------------

def _stats_sql(source: str, inputs: list[str]) -> str:
    body = f"SELECT clip_id, canonical_label, {', '.join(STATISTICS)} FROM stats"
    return tidied(with_inputs(inputs, body, **score_parts(source)), *STATISTICS)


@register("score_statistics", _stats_sql("frame_scores", EVENTS))
def score_statistics_query(spark, d):
    return tidy(events_statistics(spark, d).select(*KEYS, *STATISTICS))


@register("score_statistics_large_groups", _stats_sql("frame_scores", EVENTS))
def score_statistics_large_query(spark, d):
    """The same result with a group limit so low that the histogram way serves the big groups."""
    return tidy(score_statistics(events_canonical(spark, d), PROFILE, limit=12).select(*KEYS, *STATISTICS))


@register("top_fraction_mean", tidied(with_inputs(EVENTS, "SELECT clip_id, canonical_label, top_mean FROM stats", **score_parts("frame_scores")), "top_mean"))
def top_fraction_query(spark, d):
    return tidy(top_fraction_mean(events_canonical(spark, d), KEYS))


@register("presence_decision", tidied(with_inputs(EVENTS, "SELECT clip_id, canonical_label, score, decision FROM decided", **score_parts("frame_scores")), "score"))
def presence_decision(spark, d):
    return tidy(decide(presence_score(events_statistics(spark, d))).select(*KEYS, "score", "decision"))


@register("presence_score", tidied(with_inputs(VECTORS, "SELECT clip_id, canonical_label, top_mean, p95, score FROM decided", **score_parts("raw_scores")), "top_mean", "p95", "score"))
def presence_score_query(spark, d):
    windows = A.window_vectors(spark, d)
    stats = score_statistics(canonical_scores_dense(windows, A.RAW), PROFILE, known_small=small_clips(windows))
    return tidy(presence_score(stats).select(*KEYS, "top_mean", "p95", "score"))


# labels that the profile may confirm, paired up so that the rule has something to do
GROUPS = {"bass": "low", "strings": "low", "piano": "keys", "synth": "keys"}
GROUPED = {label: (raws, parent, GROUPS.get(label)) for label, (raws, parent, _) in C.TAXONOMY.items()}
_GROUP_SQL = " ".join(f"WHEN '{label}' THEN '{group}'" for label, group in GROUPS.items())


@register("demote_ambiguous", tidied(with_inputs(EVENTS, """
    SELECT clip_id, canonical_label, score,
           CASE WHEN grp IS NOT NULL AND decision = 'confirmed' AND
                     max(score) FILTER (rk = 1) OVER g - max(score) FILTER (rk = 2) OVER g < 0.08::DOUBLE
                THEN 'candidate' ELSE decision END AS decision
    FROM placed WINDOW g AS (PARTITION BY clip_id, grp)""", **score_parts("frame_scores"),
    placed=f"""SELECT *, row_number() OVER (PARTITION BY clip_id, grp ORDER BY score DESC, canonical_label) AS rk
               FROM (SELECT *, CASE canonical_label {_GROUP_SQL} END AS grp FROM decided)"""), "score"))
def demote_query(spark, d):
    decided = decide(presence_score(events_statistics(spark, d)))
    return tidy(demote_ambiguous(decided.select(*KEYS, "score", "decision"), taxonomy=GROUPED))


# --- windows -----------------------------------------------------------------------

@register("sliding_windows", tidied("""
    SELECT clip_id, k AS window_idx, k * 50 / 100.0::DOUBLE AS start_s, least(k * 50 + 100, n) / 100.0::DOUBLE AS end_s
    FROM (SELECT doc_id AS clip_id, n_chars AS n,
                 unnest(range(0, least(greatest(0, ceil((n_chars - 100) / 50.0))::BIGINT + 1, ceil(n_chars / 50.0)::BIGINT))) AS k
          FROM documents WHERE n_chars > 0)""", "start_s", "end_s"))
def sliding_windows_query(spark, d):
    clips = A.table(spark, d, "documents").select(
        F.col("doc_id").alias("clip_id"), F.col("n_chars").alias("n_samples"), F.lit(100).alias("sample_rate")
    )
    return tidy(sliding_windows(clips, 1.0, 0.5).withColumn("window_idx", F.col("window_idx").cast("long")))


@register("cadence_bounds", tidied("""
    SELECT clip_id, k AS window_idx, k * 0.992::DOUBLE AS start_s, least(duration_s, k * 0.992::DOUBLE + 2.048::DOUBLE) AS end_s
    FROM (SELECT doc_id AS clip_id, n_chars / 100.0::DOUBLE AS duration_s,
                 unnest(range(0, floor(n_chars / 100.0::DOUBLE / 0.992::DOUBLE)::BIGINT + 1)) AS k FROM documents)""", "start_s", "end_s"))
def cadence_query(spark, d):
    duration = F.col("n_chars") / F.lit(100.0)
    windows = A.table(spark, d, "documents").select(
        F.col("doc_id").alias("clip_id"),
        duration.alias("duration_s"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(duration / F.lit(0.992)))).alias("window_idx"),
    )
    return tidy(cadence_bounds(windows, 16000).drop("duration_s"))


# --- intervals ---------------------------------------------------------------------

@register("hysteresis_activity", tidied(with_inputs(EVENTS, "SELECT clip_id, canonical_label, window_idx, score, is_active FROM switched", **score_parts("frame_scores"), **interval_parts()), "score"))
def hysteresis_query(spark, d):
    ruled = with_rules(events_canonical(spark, d), PROFILE)
    active = hysteresis(ruled, slice_rows=SLICE_ROWS)
    return tidy(active.select("clip_id", "canonical_label", "window_idx", "score", "is_active"))


@register("merge_gaps", tidied(with_inputs(EVENTS, "SELECT clip_id, canonical_label, start_s, end_s, peak_score, score_sum, n_windows FROM ranges", **score_parts("frame_scores"), **interval_parts()), "start_s", "end_s", "peak_score", "score_sum"))
def merge_gaps_query(spark, d):
    ruled = with_rules(events_canonical(spark, d), PROFILE)
    return tidy(merge_gaps(hysteresis(ruled, slice_rows=SLICE_ROWS), slice_rows=SLICE_ROWS))


_INTERVAL_DOUBLES = ("start_s", "end_s", "peak_score", "confidence")


_INTERVALS_SQL = tidied(with_inputs(EVENTS, "SELECT * FROM intervals", **score_parts("frame_scores"), **interval_parts()), *_INTERVAL_DOUBLES)


@register("activity_intervals", _INTERVALS_SQL)
def intervals_query(spark, d):
    scores = A.frame_scores(spark, d)
    return tidy(label_intervals(canonical_scores(scores), PROFILE, slice_rows=slice_for(scores, ["clip_id"])))


@register("activity_intervals_sliced", _INTERVALS_SQL)
def intervals_sliced_query(spark, d):
    """The same rows with slices of 48 hours stitched together."""
    return tidy(label_intervals(events_canonical(spark, d), PROFILE, slice_rows=SLICE_ROWS))


_ACTIVITY_GROUP = """
    SELECT clip_id, canonical_label, score, CASE WHEN grp IS NOT NULL AND decision = 'confirmed' AND
           max(score) FILTER (rk = 1) OVER g - max(score) FILTER (rk = 2) OVER g < 0.08::DOUBLE
           THEN 'candidate' ELSE decision END AS decision
    FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, grp ORDER BY score DESC, canonical_label) AS rk
          FROM (SELECT *, CASE WHEN canonical_label IN ('acoustic_guitar', 'electric_guitar') THEN 'guitar_subtype' END AS grp FROM decided))
    WINDOW g AS (PARTITION BY clip_id, grp)"""
_ACTIVITY = """
    SELECT f.clip_id, f.canonical_label, n.display_name, f.decision, f.score, i.start_s, i.end_s, i.peak_score, i.confidence, i.n_windows
    FROM final f LEFT JOIN intervals i USING (clip_id, canonical_label)
    JOIN (SELECT DISTINCT canonical_label, display_name FROM taxonomy) n USING (canonical_label)"""


def _activity_sql(source: str, inputs: list[str]) -> str:
    parts = score_parts(source) | interval_parts() | {"final": _ACTIVITY_GROUP}
    return tidied(with_inputs(inputs, _ACTIVITY, **parts), "score", *_INTERVAL_DOUBLES)


@register("label_activity", _activity_sql("frame_scores", EVENTS))
def label_activity_query(spark, d):
    scores = A.frame_scores(spark, d)
    return tidy(label_activity(canonical_scores(scores), PROFILE, sized_by=scores))


@register("label_activity_dense", _activity_sql("raw_scores", VECTORS))
def label_activity_dense_query(spark, d):
    windows = A.window_vectors(spark, d)
    dense = canonical_scores_dense(windows, A.RAW)
    return tidy(label_activity(dense, PROFILE, sized_by=windows))


@register("label_activity_large_clips", _activity_sql("frame_scores", EVENTS))
def label_activity_large_query(spark, d):
    """The same with a limit so low that every step takes its sliced way."""
    scores = A.frame_scores(spark, d)
    return tidy(label_activity(canonical_scores(scores), PROFILE, sized_by=scores, limit=20))
