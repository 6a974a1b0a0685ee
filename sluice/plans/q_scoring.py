"""Registered queries: model fan-out, scoring, best pick and score statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.numeric import round_ratio_sql
from sluice.operators import scoring as SC
from sluice.operators import summaries as SM
from sluice.operators.merge import upsert_results
from sluice.plans.q_summaries import MODEL_COMPARISON_SQL
from sluice.plans.registry import register
from sluice.schemas import MODEL_NAMES, models_dim
from sluice.sources import bindings as B

QA = B.with_ctes(B.QA_CTE)
MR = B.with_ctes(B.QA_CTE, B.MR_CTE, B.MODELS_CTE)


@register("model_fanout", QA + f"""
, models AS (SELECT * FROM {B.models_sql_values()})
SELECT qa.id AS question_id, models.model_name, models.provider, models.cost_tier FROM qa CROSS JOIN models""")
def model_fanout(spark, sf):
    fan = SC.model_fanout(B.qa_pairs(spark, sf), models_dim(spark))
    return fan.select(F.col("id").alias("question_id"), "model_name", "provider", "cost_tier")


@register("model_subset", QA + f"""
, models AS (SELECT * FROM {B.models_sql_values()} WHERE model_name IN ('gpt-4o'))
SELECT qa.id AS question_id, models.model_name FROM qa CROSS JOIN models""")
def model_subset(spark, sf):
    # 'no-such-model' is dropped; gpt-4o remains (all models only if none is valid)
    models = models_dim(spark, ["gpt-4o", "no-such-model"])
    return SC.model_fanout(B.qa_pairs(spark, sf), models).select(F.col("id").alias("question_id"), "model_name")


BEST_SQL = """
best AS (
  SELECT question_id, model_name AS best_model, answer AS best_answer, quality_score AS best_score
  FROM (SELECT mr.*, row_number() OVER (PARTITION BY question_id ORDER BY quality_score DESC, models.ordinal) AS rn
        FROM mr JOIN models USING (model_name))
  WHERE rn = 1
)"""


@register("best_model_per_question", MR + "," + BEST_SQL + " SELECT * FROM best")
def best_model_per_question(spark, sf):
    return SC.best_model_per_question(B.model_results(spark, sf), models_dim(spark))


SPREAD_SQL = f"""
spread AS (
  SELECT a.question_id, b.best_model, a.best_score,
         CASE WHEN n > 0 THEN {round_ratio_sql('n * sxx - sx * sx', 'n * n * 10000', 6)} END AS score_variance,
         CAST(rt AS DOUBLE) / 100 AS processing_time_total
  FROM (SELECT question_id, count(quality_score) AS n, sum(CAST(round(quality_score * 100) AS BIGINT)) AS sx,
               sum(CAST(round(quality_score * 100) AS BIGINT) * CAST(round(quality_score * 100) AS BIGINT)) AS sxx,
               sum(CAST(round(response_time * 100) AS BIGINT)) AS rt, max(quality_score) AS best_score
        FROM mr GROUP BY question_id) a
  JOIN best b USING (question_id)
)"""


@register("score_spread", MR + "," + BEST_SQL + "," + SPREAD_SQL + " SELECT * FROM spread")
def score_spread(spark, sf):
    return SC.score_spread(B.model_results(spark, sf), models_dim(spark))


def _wide_sql() -> str:
    cols = []
    for m in MODEL_NAMES:
        p = SC.WIDE_PREFIX[m]
        for src, dst in (("answer", "answer"), ("quality_score", "score"), ("response_time", "response_time")):
            cols.append(f"max(CASE WHEN model_name = '{m}' THEN {src} END) AS {p}_{dst}")
    return ("SELECT w.*, s.best_model, s.best_score, s.score_variance, s.processing_time_total FROM "
            f"(SELECT question_id, {', '.join(cols)} FROM mr GROUP BY question_id) w JOIN spread s USING (question_id)")


@register("wide_model_results", MR + "," + BEST_SQL + "," + SPREAD_SQL + _wide_sql())
def wide_model_results(spark, sf):
    return SC.wide_model_results(B.model_results(spark, sf), models_dim(spark))


@register("pivot_model_scores", MR + """
SELECT question_id, max(CASE WHEN model_name = 'gpt-4o' THEN quality_score END) AS "gpt-4o",
       max(CASE WHEN model_name = 'gpt-4o-mini' THEN quality_score END) AS "gpt-4o-mini",
       max(CASE WHEN model_name = 'mistral-nemo' THEN quality_score END) AS "mistral-nemo"
FROM mr GROUP BY question_id""")
def pivot_model_scores(spark, sf):
    return SC.pivot_model_scores(B.model_results(spark, sf))


UPSERT_RESULTS_SQL = """
newr AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, model_name ORDER BY created_at DESC, answer DESC) AS rn
    FROM incoming) WHERE rn = 1
),
merged AS (
  SELECT coalesce(o.question_id, n.question_id) AS question_id,
         coalesce(o.model_name, n.model_name) AS model_name,
         CASE WHEN o.model_name IS NOT NULL THEN o.model_provider ELSE n.model_provider END AS model_provider,
         CASE WHEN n.model_name IS NOT NULL THEN n.answer ELSE o.answer END AS answer,
         CASE WHEN n.model_name IS NOT NULL THEN n.quality_score ELSE o.quality_score END AS quality_score,
         CASE WHEN n.model_name IS NOT NULL THEN n.response_time ELSE o.response_time END AS response_time,
         CASE WHEN o.model_name IS NOT NULL THEN o.cost_tier ELSE n.cost_tier END AS cost_tier,
         CASE WHEN n.model_name IS NOT NULL THEN n.created_at ELSE o.created_at END AS created_at
  FROM mr o FULL OUTER JOIN newr n ON o.question_id = n.question_id AND o.model_name = n.model_name
)"""

FLAGSHIP_SQL = (B.with_ctes(B.QA_CTE, B.MR_CTE, B.INCOMING_CTE) + "," + UPSERT_RESULTS_SQL
                + MODEL_COMPARISON_SQL.replace("FROM mr ", "FROM merged "))


@register("flagship", FLAGSHIP_SQL)
def flagship(spark, sf):
    """QA x models -> hash score -> upsert of a second run -> model comparison."""
    merged = upsert_results(B.model_results(spark, sf), B.incoming_results(spark, sf))
    return SM.model_comparison(merged)
