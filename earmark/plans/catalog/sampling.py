"""Quota sampling, leakage checks and late payload fetch."""

from __future__ import annotations

from pyspark.sql import functions as F

from earmark import constants as C
from earmark.operators.sampling import (
    greedy_partial_sample,
    late_fetch,
    leaking_groups,
    quota_sample,
    quota_shortfalls,
    second_split,
    seeded_order,
)
from earmark.plans import adapters as A
from earmark.plans.adapters import with_inputs
from earmark.plans.catalog.registry import register

QUOTA = 20
SECOND_QUOTA = 50
SEED = 7
LABELS = C.TARGET_LABELS[:4]

_DRAWN = """
    SELECT sample_id, label, target FROM (
        SELECT *, row_number() OVER (PARTITION BY label, target ORDER BY md5(sample_id::VARCHAR || ':7'), sample_id) AS rk
        FROM partial_pool WHERE target IS NOT NULL{where}) WHERE rk <= {quota}"""
_FIRST = _DRAWN.format(where="", quota=QUOTA)
_SECOND = _DRAWN.format(where=" AND sample_id NOT IN (SELECT sample_id FROM first_split)", quota=SECOND_QUOTA)


def _order():
    return [seeded_order("sample_id", SEED)]


def _first(spark, d):
    return quota_sample(A.partial_pool(spark, d), QUOTA, _order())


def _second(spark, d):
    bound = QUOTA * len(LABELS) * 2
    return second_split(A.partial_pool(spark, d), _first(spark, d), SECOND_QUOTA, _order())


@register("quota_sample", with_inputs(["partial_pool"], _FIRST))
def quota_query(spark, d):
    return _first(spark, d)


@register("second_split", with_inputs(["partial_pool"], "SELECT * FROM second", first_split=_FIRST, second=_SECOND))
def second_query(spark, d):
    return _second(spark, d)


@register("quota_shortfalls", with_inputs(["partial_pool"], """
    SELECT l.label, t.target, count(s.sample_id) AS drawn
    FROM (SELECT DISTINCT label FROM partial_pool) l CROSS JOIN (VALUES (true), (false)) AS t(target)
    LEFT JOIN second s ON s.label = l.label AND s.target = t.target
    GROUP BY ALL HAVING count(s.sample_id) < 200 AND NOT (t.target AND count(s.sample_id) >= 1)""",
    first_split=_FIRST, second=_SECOND))
def shortfall_query(spark, d):
    return quota_shortfalls(_second(spark, d), LABELS, 200, tolerate_positive=True)


@register("greedy_partial_sample", with_inputs(["partial_pool"], f"""
    SELECT sample_id, label, target FROM partial_pool WHERE target IS NOT NULL AND sample_id IN (
        SELECT sample_id FROM (SELECT *, row_number() OVER (PARTITION BY label, target ORDER BY sample_id) AS rk
                               FROM partial_pool WHERE target IS NOT NULL) WHERE rk <= {QUOTA})"""))
def greedy_query(spark, d):
    return greedy_partial_sample(A.partial_pool(spark, d), QUOTA, [])


@register("leaking_groups", """
    SELECT * FROM (SELECT l_suppkey::VARCHAR AS group_id, count_if(l_orderkey % 10 < 3)::BIGINT AS calibration_rows,
                          count_if(l_orderkey % 10 >= 3)::BIGINT AS evaluation_rows FROM lineitem GROUP BY ALL)
    WHERE calibration_rows > 0 AND evaluation_rows > 0""")
def leak_query(spark, d):
    split = F.when(F.col("l_orderkey") % 10 < 3, "calibration").otherwise("evaluation")
    samples = A.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("group_id"), split.alias("split"))
    return leaking_groups(samples)


@register("late_fetch", with_inputs(["partial_pool"], """
    SELECT doc_id AS sample_id, source, sha256(text) AS digest FROM documents WHERE doc_id IN (SELECT sample_id FROM first_split)""",
    first_split=_FIRST))
def late_fetch_query(spark, d):
    wide = A.table(spark, d, "documents").withColumnRenamed("doc_id", "sample_id")
    fetched = late_fetch(_first(spark, d), wide, "sample_id", ["source", "text"])
    return fetched.select("sample_id", "source", F.sha2("text", 256).alias("digest"))
