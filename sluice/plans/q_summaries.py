"""Registered queries: scans, summary views, stats function, model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.numeric import avg_rounded, avg_rounded_sql
from sluice.operators import summaries as SM
from sluice.plans.registry import register
from sluice.sources import bindings as B

Q = B.with_ctes(B.QUESTIONS_CTE)
MR = B.with_ctes(B.QA_CTE, B.MR_CTE)


@register("table_scan", Q + "SELECT * FROM questions")
def table_scan(spark, sf):
    return B.counted_questions(spark, sf)


@register("questions_summary", Q + f"""
SELECT COALESCE(original_class, -1) AS original_class,
       count(*) AS question_count,
       count(CASE WHEN llm_answer IS NOT NULL THEN 1 END) AS processed_count,
       {avg_rounded_sql('quality_score', 2, 3, where='quality_score > 0')} AS avg_score,
       max(access_count) AS max_access_count
FROM questions GROUP BY original_class""")
def questions_summary(spark, sf):
    return SM.questions_summary(B.counted_questions(spark, sf))


@register("conditional_count", Q + """
SELECT count(CASE WHEN llm_answer IS NOT NULL THEN 1 END) AS processed,
       count(CASE WHEN quality_score > 0 THEN 1 END) AS positive_scores,
       count(CASE WHEN llm_answer IS NULL OR llm_answer = '' THEN 1 END) AS unprocessed
FROM questions""")
def conditional_count(spark, sf):
    q = B.questions(spark, sf)
    return q.agg(
        F.count_if(F.col("llm_answer").isNotNull()).alias("processed"),
        F.count_if(F.col("quality_score") > 0).alias("positive_scores"),
        F.count_if(F.col("llm_answer").isNull() | (F.col("llm_answer") == "")).alias("unprocessed"),
    )


@register("questions_stats", Q + f"""
SELECT count(*) AS total_questions,
       count(CASE WHEN llm_answer IS NOT NULL THEN 1 END) AS processed_questions,
       {avg_rounded_sql('quality_score', 2, 3, where='quality_score > 0')} AS avg_quality_score,
       (SELECT original_class FROM questions WHERE original_class IS NOT NULL
        GROUP BY original_class ORDER BY count(*) DESC, original_class LIMIT 1) AS top_class,
       (SELECT question_title FROM questions WHERE question_title IS NOT NULL
        ORDER BY access_count DESC, id LIMIT 1) AS most_accessed_question
FROM questions""")
def questions_stats(spark, sf):
    return SM.questions_stats(B.counted_questions(spark, sf))


@register("mode_class", Q + """
SELECT original_class AS top_class FROM questions WHERE original_class IS NOT NULL
GROUP BY original_class ORDER BY count(*) DESC, original_class LIMIT 1""")
def mode_class(spark, sf):
    return SM.mode_class(B.questions(spark, sf))


@register("top1_accessed", Q + """
SELECT question_title AS most_accessed_question FROM questions WHERE question_title IS NOT NULL
ORDER BY access_count DESC, id LIMIT 1""")
def top1_accessed(spark, sf):
    return SM.top1_accessed(B.counted_questions(spark, sf))


MODEL_COMPARISON_SQL = f"""
SELECT model_name, model_provider, count(*) AS total_answers,
       {avg_rounded_sql('quality_score', 2, 3)} AS avg_quality_score,
       {avg_rounded_sql('response_time', 2, 3)} AS avg_response_time,
       cost_tier,
       count(CASE WHEN quality_score >= 2.5 THEN 1 END) AS high_quality_answers
FROM mr GROUP BY model_name, model_provider, cost_tier"""


@register("model_comparison", MR + MODEL_COMPARISON_SQL)
def model_comparison(spark, sf):
    return SM.model_comparison(B.model_results(spark, sf))


@register("order_summary", MR + MODEL_COMPARISON_SQL + " ORDER BY avg_quality_score DESC NULLS FIRST")
def order_summary(spark, sf):
    return SM.model_comparison(B.model_results(spark, sf))


@register("model_ranking", MR + f"""
SELECT model_name, avg_quality_score, CAST(rank() OVER (ORDER BY avg_quality_score DESC NULLS FIRST) AS INTEGER) AS quality_rank
FROM ({MODEL_COMPARISON_SQL})""")
def model_ranking(spark, sf):
    return SM.model_ranking(B.model_results(spark, sf))


@register("model_consistency", MR + """
SELECT model_name, count(*) AS n, round(stddev_samp(quality_score), 6) AS score_stddev,
       min(quality_score) AS min_score, max(quality_score) AS max_score
FROM mr GROUP BY model_name""")
def model_consistency(spark, sf):
    return SM.model_consistency(B.model_results(spark, sf))


@register("register_views", Q + f"""
SELECT COALESCE(original_class, -1) AS original_class, count(*) AS question_count,
       count(CASE WHEN llm_answer IS NOT NULL THEN 1 END) AS processed_count,
       {avg_rounded_sql('quality_score', 2, 3, where='quality_score > 0')} AS avg_score,
       max(access_count) AS max_access_count
FROM questions GROUP BY original_class""")
def register_views(spark, sf):
    """The summary view defined in Spark SQL over the registered ``questions`` view."""
    from sluice.plans.views import register_views as reg

    reg(spark, sf)
    return spark.sql("SELECT * FROM questions_summary")


@register("model_comparison_view", MR + MODEL_COMPARISON_SQL)
def model_comparison_view(spark, sf):
    from sluice.plans.views import register_views as reg

    reg(spark, sf)
    return spark.sql("SELECT * FROM model_comparison")


@register("stats_table_function", Q + f"""
SELECT count(*) AS total_questions,
       count(CASE WHEN llm_answer IS NOT NULL THEN 1 END) AS processed_questions,
       {avg_rounded_sql('quality_score', 2, 3, where='quality_score > 0')} AS avg_quality_score,
       (SELECT original_class FROM questions WHERE original_class IS NOT NULL
        GROUP BY original_class ORDER BY count(*) DESC, original_class LIMIT 1) AS top_class,
       (SELECT question_title FROM questions WHERE question_title IS NOT NULL
        ORDER BY access_count DESC, id LIMIT 1) AS most_accessed_question
FROM questions""")
def stats_table_function(spark, sf):
    from sluice.plans.views import register_stats_function

    register_stats_function(spark, sf)
    return spark.sql("SELECT * FROM get_questions_stats()")


@register("rounding", MR + f"""
SELECT model_name, {avg_rounded_sql('quality_score', 2, 2)} AS avg_score_2dp,
       {avg_rounded_sql('quality_score', 2, 3)} AS avg_score_3dp,
       {avg_rounded_sql('response_time', 2, 3)} AS avg_time_3dp
FROM mr GROUP BY model_name""")
def rounding(spark, sf):
    mr = B.model_results(spark, sf)
    return mr.groupBy("model_name").agg(avg_rounded(F.col("quality_score"), 2, 2).alias("avg_score_2dp"),
                                        avg_rounded(F.col("quality_score"), 2, 3).alias("avg_score_3dp"),
                                        avg_rounded(F.col("response_time"), 2, 3).alias("avg_time_3dp"))
