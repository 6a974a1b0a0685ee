"""Summary views and the stats table function over ``questions`` and results.

All are single-pass aggregations: partial (map-side) aggregation runs before
the shuffle, so a hot class or model only sends one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.numeric import avg_rounded
from sluice.functions.predicates import high_quality, is_processed, positive_only
from sluice.schemas import HIGH_QUALITY_THRESHOLD


def questions_summary(q: DataFrame) -> DataFrame:
    """Per class: count, processed count, avg positive score (3 dp), max access count.

    Groups on the raw class, so NULL and a real -1 stay two rows (both shown as
    -1), then ordered by the output class.
    """
    agg = q.groupBy("original_class").agg(
        F.count(F.lit(1)).alias("question_count"),
        F.count_if(is_processed(F.col("llm_answer"))).alias("processed_count"),
        avg_rounded(positive_only(F.col("quality_score")), 2, 3).alias("avg_score"),
        F.max("access_count").alias("max_access_count"),
    )
    return agg.select(
        F.coalesce(F.col("original_class"), F.lit(-1)).alias("original_class"),
        "question_count", "processed_count", "avg_score", "max_access_count",
    ).orderBy(F.col("original_class").asc_nulls_last())


def mode_class(q: DataFrame) -> DataFrame:
    """Most frequent non-null class; ties -> smallest class."""
    return (q.filter(F.col("original_class").isNotNull())
            .groupBy("original_class").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("original_class")).limit(1)
            .select(F.col("original_class").alias("top_class")))


def top1_accessed(q: DataFrame) -> DataFrame:
    """Title with the largest access count; ties -> smallest id (TakeOrderedAndProject)."""
    return (q.filter(F.col("question_title").isNotNull())
            .orderBy(F.desc("access_count"), F.asc("id")).limit(1)
            .select(F.col("question_title").alias("most_accessed_question")))


def questions_stats(q: DataFrame) -> DataFrame:
    """One row from one pass: total, processed, average positive score, most frequent class (ties: smallest),
    most accessed title (ties: smallest id). Partial aggregates leave one row a task; the counts behind the
    mode are one per class."""
    titled = F.col("question_title").isNotNull()
    return q.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if(is_processed(F.col("llm_answer"))).alias("processed_questions"),
        avg_rounded(positive_only(F.col("quality_score")), 2, 3).alias("avg_quality_score"),
        F.mode("original_class", deterministic=True).alias("top_class"),
        F.max_by("question_title", F.when(titled, F.struct(F.col("access_count"), -F.col("id")))).alias("most_accessed_question"),
    )


def model_comparison(mr: DataFrame, threshold: float = HIGH_QUALITY_THRESHOLD) -> DataFrame:
    """Per (model, provider, tier): answers, avg score/time (3 dp), high-quality count."""
    agg = mr.groupBy("model_name", "model_provider", "cost_tier").agg(
        F.count(F.lit(1)).alias("total_answers"),
        avg_rounded(F.col("quality_score"), 2, 3).alias("avg_quality_score"),
        avg_rounded(F.col("response_time"), 2, 3).alias("avg_response_time"),
        F.count_if(high_quality(F.col("quality_score"), threshold)).alias("high_quality_answers"),
    )
    # PostgreSQL sorts NULLs first in DESC order
    return agg.select("model_name", "model_provider", "total_answers", "avg_quality_score",
                      "avg_response_time", "cost_tier", "high_quality_answers") \
        .orderBy(F.col("avg_quality_score").desc_nulls_first())


def model_ranking(mr: DataFrame) -> DataFrame:
    """Rank models by average quality (window over the few comparison rows)."""
    cmp = model_comparison(mr)
    w = Window.orderBy(F.col("avg_quality_score").desc_nulls_first())
    return cmp.select("model_name", "avg_quality_score", F.rank().over(w).alias("quality_rank"))


def model_consistency(mr: DataFrame) -> DataFrame:
    """Spread of each model's scores (sample stddev, min, max)."""
    return mr.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.stddev_samp("quality_score"), 6).alias("score_stddev"),
        F.min("quality_score").alias("min_score"),
        F.max("quality_score").alias("max_score"),
    )
