"""Model fan-out, best pick and per-question score statistics.

The model catalogue is a fixed 3-row dimension, so fanning out is a
broadcast cross join (bounded by construction). All per-question statistics
are one ``groupBy(question_id)`` with partial aggregation, so a question never
holds more rows than there are models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import scoring as S
from sluice.functions import text as X
from sluice.functions.numeric import round_ratio, scaled
from sluice.schemas import MODEL_NAMES

# Column prefixes of the wide result table, in catalogue order (fixed values).
WIDE_PREFIX = {"gpt-4o": "gpt4o", "gpt-4o-mini": "gpt4o_mini", "mistral-nemo": "mistral"}


def model_fanout(questions: DataFrame, models: DataFrame) -> DataFrame:
    """Every question x every selected model."""
    return questions.crossJoin(F.broadcast(models))


def with_ordinal(results: DataFrame, models: DataFrame) -> DataFrame:
    if "ordinal" in results.columns:
        return results
    return results.join(F.broadcast(models.select("model_name", "ordinal")), "model_name", "left")


def best_model_per_question(results: DataFrame, models: DataFrame) -> DataFrame:
    """Highest score per question; ties -> first model in catalogue order."""
    r = with_ordinal(results, models)
    rank_key = F.struct(F.col("quality_score"), (-F.coalesce(F.col("ordinal"), F.lit(1 << 30))).alias("o"))
    best = F.max_by(F.struct("model_name", "answer", "quality_score"), rank_key)
    return r.groupBy("question_id").agg(best.alias("b")).select(
        "question_id",
        F.col("b.model_name").alias("best_model"),
        F.col("b.answer").alias("best_answer"),
        F.col("b.quality_score").alias("best_score"),
    )


def _spread_aggs(r: DataFrame):
    x = scaled(F.col("quality_score"), 2)
    n = F.count(F.col("quality_score"))
    sx = F.sum(x)
    sxx = F.sum(x * x)
    rank_key = F.struct(F.col("quality_score"), (-F.coalesce(F.col("ordinal"), F.lit(1 << 30))).alias("o"))
    return [
        F.max_by(F.col("model_name"), rank_key).alias("best_model"),
        F.max("quality_score").alias("best_score"),
        n.alias("_n"), sx.alias("_sx"), sxx.alias("_sxx"),
        F.sum(scaled(F.col("response_time"), 2)).alias("_rt"),
    ]


def _spread_cols():
    # population variance from exact integer sums (scores have 2 decimals)
    num = F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    den = F.col("_n") * F.col("_n") * 10000
    return [
        "best_model", "best_score",
        F.when(F.col("_n") > 0, round_ratio(num, den, 6)).alias("score_variance"),
        (F.col("_rt").cast("double") / 100).alias("processing_time_total"),
    ]


def score_spread(results: DataFrame, models: DataFrame) -> DataFrame:
    """best_model, best_score, population score variance, total response time per question."""
    r = with_ordinal(results, models)
    return r.groupBy("question_id").agg(*_spread_aggs(r)).select("question_id", *_spread_cols())


def wide_model_results(results: DataFrame, models: DataFrame) -> DataFrame:
    """One row per question: answer/score/time per model plus the spread columns.

    Conditional aggregation over the known model list (what ``pivot`` with a
    value list compiles to), fused with the spread statistics in one shuffle.
    """
    r = with_ordinal(results, models)
    pivots = []
    for m in MODEL_NAMES:
        p = WIDE_PREFIX[m]
        is_m = F.col("model_name") == m
        pivots += [
            F.max(F.when(is_m, F.col("answer"))).alias(f"{p}_answer"),
            F.max(F.when(is_m, F.col("quality_score"))).alias(f"{p}_score"),
            F.max(F.when(is_m, F.col("response_time"))).alias(f"{p}_response_time"),
        ]
    g = r.groupBy("question_id").agg(*pivots, *_spread_aggs(r))
    wide_cols = [f"{WIDE_PREFIX[m]}_{k}" for m in MODEL_NAMES for k in ("answer", "score", "response_time")]
    return g.select("question_id", *wide_cols, *_spread_cols())


def pivot_model_scores(results: DataFrame) -> DataFrame:
    """The DataFrame ``pivot`` form: one score column per model name."""
    return results.groupBy("question_id").pivot("model_name", MODEL_NAMES).agg(F.first("quality_score"))
