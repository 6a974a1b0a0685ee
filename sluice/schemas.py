"""Schemas and fixed dimension values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference for equal results: model catalogue with its answer templates,
# policies, sizes, thresholds and defaults.
TEMPLATE_DETAILED = (
    "Respecto a {topic}, es importante considerar varios aspectos fundamentales. Esta pregunta involucra "
    "elementos técnicos específicos que requieren análisis detallado y consideración de múltiples variables "
    "para una comprensión completa."
)
TEMPLATE_CONCISE = (
    "En relación con {topic}, la respuesta implica factores específicos que deben evaluarse según el contexto "
    "y los objetivos planteados."
)
TEMPLATE_BALANCED = (
    "Sobre {topic}, podemos explicar que involucra varios conceptos importantes que se interrelacionan de "
    "manera específica según las circunstancias."
)

# (ordinal, model_name, provider, context_length, cost_tier, strengths, avg_response_time,
#  quality_lo, quality_hi, response_style, template)
MODEL_ROWS = [
    (1, "gpt-4o", "OpenAI", 128000, "premium", ["reasoning", "coding", "analysis", "multimodal"], 0.05,
     "2.3", "3.0", "detailed", TEMPLATE_DETAILED),
    (2, "gpt-4o-mini", "OpenAI", 128000, "economy", ["general", "cost-effective", "speed"], 0.02,
     "2.0", "2.8", "concise", TEMPLATE_CONCISE),
    (3, "mistral-nemo", "Mistral", 128000, "standard", ["multilingual", "reasoning", "cost-effective"], 0.03,
     "2.1", "2.9", "balanced", TEMPLATE_BALANCED),
]
MODEL_NAMES = [r[1] for r in MODEL_ROWS]

POLICIES = ["LRU", "TTL", "TTL-LRU"]
CACHE_SIZES = [10, 100, 500, 1000, 2000]
DEFAULT_TTL_SECONDS = 3600
HIGH_QUALITY_THRESHOLD = 2.5
FAILURE_SCORE = 1.0
DEFAULT_CACHED_SCORE = 2.0
DEFAULT_ANSWER = "Respuesta predeterminada"
FALLBACK_TOPIC = "tema"

MODELS_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("model_name", T.StringType(), False),
    T.StructField("provider", T.StringType(), False),
    T.StructField("context_length", T.IntegerType(), False),
    T.StructField("cost_tier", T.StringType(), False),
    T.StructField("strengths", T.ArrayType(T.StringType()), False),
    T.StructField("avg_response_time", T.DoubleType(), False),
    T.StructField("quality_lo", T.StringType(), False),
    T.StructField("quality_hi", T.StringType(), False),
    T.StructField("response_style", T.StringType(), False),
    T.StructField("template", T.StringType(), False),
])

QUESTIONS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("question_title", T.StringType(), False),
    T.StructField("question_content", T.StringType(), True),
    T.StructField("original_answer", T.StringType(), True),
    T.StructField("llm_answer", T.StringType(), True),
    T.StructField("quality_score", T.DoubleType(), True),
    T.StructField("access_count", T.IntegerType(), True),
    T.StructField("original_class", T.IntegerType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
    T.StructField("first_access", T.TimestampNTZType(), True),
    T.StructField("last_access", T.TimestampNTZType(), True),
])

RAW_CSV_SCHEMA = T.StructType([
    T.StructField("original_class", T.IntegerType(), True),
    T.StructField("question_title", T.StringType(), True),
    T.StructField("question_content", T.StringType(), True),
    T.StructField("original_answer", T.StringType(), True),
])

RESULTS_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType(), True),
    T.StructField("model_name", T.StringType(), False),
    T.StructField("model_provider", T.StringType(), True),
    T.StructField("answer", T.StringType(), True),
    T.StructField("quality_score", T.DoubleType(), True),
    T.StructField("response_time", T.DoubleType(), True),
    T.StructField("cost_tier", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

CONFIG_METRICS_SCHEMA = T.StructType([
    T.StructField("policy", T.StringType(), False),
    T.StructField("cache_size", T.IntegerType(), False),
    T.StructField("hit_rate_percent", T.DoubleType(), False),
    T.StructField("miss_rate_percent", T.DoubleType(), False),
    T.StructField("evictions", T.LongType(), False),
    T.StructField("avg_hit_time_ms", T.DoubleType(), False),
    T.StructField("avg_miss_time_ms", T.DoubleType(), False),
    T.StructField("cache_efficiency", T.DoubleType(), False),
])


def models_dim(spark: SparkSession, selected: list[str] | None = None) -> DataFrame:
    """The 3-row model catalogue, optionally narrowed by ``model_subset`` rules."""
    df = spark.createDataFrame(MODEL_ROWS, MODELS_SCHEMA)
    if selected is None:
        return df
    valid = [m for m in selected if m in MODEL_NAMES]
    # keep requested models that exist; if none is valid use all of them
    return df.filter(F.col("model_name").isin(valid)) if valid else df


def models_sql_values() -> str:
    """Same dimension as a SQL VALUES list (for DuckDB oracles)."""
    rows = []
    for (o, name, prov, ctx, tier, _s, rt, lo, hi, style, tpl) in MODEL_ROWS:
        rows.append(f"({o}, '{name}', '{prov}', {ctx}, '{tier}', CAST({rt} AS DOUBLE), {lo}, {hi}, '{style}', '{tpl}')")
    return (
        "(VALUES " + ", ".join(rows) + ") AS m(ordinal, model_name, provider, context_length, cost_tier, "
        "avg_response_time, quality_lo, quality_hi, response_style, template)"
    )
