"""Bind the driver tables to the reference data model.

Every binding exists twice with the same expressions: once as a Spark
DataFrame and once as a DuckDB CTE (the ``*_CTE`` strings) for the oracles.

* ``questions``  documents LEFT JOIN labels
* ``qa_pairs``   user turns of conversations with the following turn
* ``model_results`` answered QA x model catalogue (long form)
* ``incoming_results`` a second model run over all QA rows (feeds upserts)
* ``access_log`` events as a cache access log
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import scoring as S
from sluice.functions import text as X
from sluice.operators.sequence import next_in_group
from sluice.schemas import models_dim, models_sql_values
from sluice.sources.tables import read_table

RESULTS_CREATED_AT = "2024-01-01 00:00:00"
INCOMING_CREATED_AT = "2024-02-01 00:00:00"


def with_access_counts(q: DataFrame) -> DataFrame:
    """``access_count``: rows per (title, content), on every row.

    Counted on a 16-byte pair key (partial aggregation, no text in that
    shuffle); only keys seen more than once are joined back, by a plain join
    that the adaptive planner shapes. Nothing runs while the plan is built.
    """
    keyed = q.withColumn("_k", X.pair_key(F.col("question_title"), F.col("question_content")))
    dups = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    out = keyed.join(dups, "_k", "left")
    return out.withColumn("access_count", F.coalesce(F.col("_n"), F.lit(1)).cast("int")).drop("_k", "_n")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question rows without ``access_count``: queries that do not read the texts never scan them."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    return docs.join(labels, on="doc_id", how="left").select(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, 60).alias("question_title"),
        F.expr("substr(text, 61)").alias("question_content"),
        F.col("lang").alias("original_answer"),
        F.when(F.col("quality").isNull(), F.lit(None).cast("string"))
        .when(F.col("quality") == 0, F.lit(""))
        .otherwise(F.col("lang")).alias("llm_answer"),
        F.col("quality").cast("double").alias("quality_score"),
        F.when(F.col("lang") == "es", F.lit(None).cast("int"))
        .otherwise(F.expr("try_cast(regexp_replace(source, '[^0-9]', '') AS INT)")).alias("original_class"),
    )


def counted_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``questions`` with ``access_count``, for the queries that use it."""
    return with_access_counts(questions(spark, sf_dir)).select(
        "id", "question_title", "question_content", "original_answer", "llm_answer", "quality_score",
        "access_count", "original_class",
    )


QUESTIONS_CTE = """
questions AS (
  SELECT *, CAST(count(*) OVER (PARTITION BY question_title, question_content) AS INTEGER) AS access_count
  FROM (
    SELECT d.doc_id AS id,
           left(d.text, 60) AS question_title,
           substr(d.text, 61) AS question_content,
           d.lang AS original_answer,
           CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 0 THEN '' ELSE d.lang END AS llm_answer,
           CAST(l.quality AS DOUBLE) AS quality_score,
           CASE WHEN d.lang = 'es' THEN NULL
                ELSE TRY_CAST(regexp_replace(d.source, '[^0-9]', '', 'g') AS INTEGER) END AS original_class
    FROM documents d LEFT JOIN labels l USING (doc_id)
  )
)"""


def qa_id(conv: str = "conv_id", turn: str = "turn"):
    """A question's key: conversation and turn. No two turns share one, however long a conversation is."""
    return F.concat_ws(":", F.col(conv).cast("string"), F.col(turn).cast("string"))


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    # only keys and roles are sliced for the look-ahead; the next turn's text joins on its key
    nxt = next_in_group(conv.select("conv_id", "turn", "role"), ["conv_id"], ["turn"], ["turn", "role"])
    asked = nxt.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.when(F.col("next_role") == "assistant", F.col("next_turn")).alias("_next"))
    texts = conv.select("conv_id", "turn", "text")
    answers = texts.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("text").alias("answer"))
    return (asked.join(texts, ["conv_id", "turn"])
            .join(answers, (F.col("conv_id") == F.col("_conv")) & (F.col("_next") == F.col("_turn")), "left")
            .select(
                qa_id().alias("id"), "conv_id", "turn",
                F.substring("text", 1, 60).alias("question_title"),
                F.expr("substr(text, 61)").alias("question_content"),
                "answer",
            ))


QA_CTE = """
qa AS (
  SELECT conv_id || ':' || turn AS id, conv_id, turn,
         left(text, 60) AS question_title,
         substr(text, 61) AS question_content,
         CASE WHEN next_role = 'assistant' THEN next_text END AS answer
  FROM (
    SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
              lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
    FROM conversations
  )
  WHERE role = 'user'
)"""


def _run_models(qa: DataFrame, models: DataFrame, run_tag: str, topic_from: str,
                created_at: str, provider_upper: bool, time_factor: int) -> DataFrame:
    # the model dimension is a fixed 3-row table: broadcasting it is always safe
    fan = qa.crossJoin(F.broadcast(models))
    topic = X.extract_topic(F.col(topic_from))
    provider = F.upper(F.col("provider")) if provider_upper else F.col("provider")
    return fan.select(
        F.col("id").alias("question_id"),
        F.col("model_name"),
        provider.alias("model_provider"),
        X.template_text(F.col("template"), topic).alias("answer"),
        S.hash_score(
            F.concat(S.score_input(F.col("question_title"), F.col("question_content")), F.lit(run_tag)),
            F.col("model_name"), F.col("quality_lo"), F.col("quality_hi"),
        ).alias("quality_score"),
        (F.col("avg_response_time") * time_factor).alias("response_time"),
        F.col("cost_tier"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
    )


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = qa_pairs(spark, sf_dir).filter(F.col("answer").isNotNull())
    return _run_models(qa, models_dim(spark), "", "question_title", RESULTS_CREATED_AT, False, 1)


def incoming_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second run over every QA row: updates answered ids, inserts the rest."""
    qa = qa_pairs(spark, sf_dir)
    return _run_models(qa, models_dim(spark), "#2", "question_content", INCOMING_CREATED_AT, True, 2)


def _results_cte(name: str, source: str, run_tag: str, topic_from: str, created_at: str,
                 provider_upper: bool, time_factor: int) -> str:
    provider = "upper(m.provider)" if provider_upper else "m.provider"
    score = S.hash_score_sql("q.question_title || chr(10) || coalesce(q.question_content, '') || " + f"'{run_tag}'",
                             "m.model_name", "m.quality_lo", "m.quality_hi")
    return f"""
{name} AS (
  SELECT q.id AS question_id, m.model_name, {provider} AS model_provider,
         replace(m.template, '{{topic}}', {X.topic_sql(f'q.{topic_from}')}) AS answer,
         {score} AS quality_score,
         m.avg_response_time * {time_factor} AS response_time,
         m.cost_tier,
         TIMESTAMP '{created_at}' AS created_at
  FROM {source} q CROSS JOIN {models_sql_values()}
)"""


MR_CTE = (
    "answered AS (SELECT * FROM qa WHERE answer IS NOT NULL),"
    + _results_cte("mr", "answered", "", "question_title", RESULTS_CREATED_AT, False, 1)
)
INCOMING_CTE = _results_cte("incoming", "qa", "#2", "question_content", INCOMING_CREATED_AT, True, 2)


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a look-up log: instance = event_type, key = user_id.

    ``seq`` (event_id) breaks timestamp ties; ``op_ms`` is the operation time
    and ``is_error`` marks failed operations.
    """
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return ev.select(
        F.col("event_type").alias("instance"),
        F.col("user_id").alias("key"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("op_ms"),
        (F.col("event_type") == "error").alias("is_error"),
    )


EV_CTE = """
ev AS (
  SELECT event_type AS instance, user_id AS key, ts, event_id AS seq, value AS op_ms,
         event_type = 'error' AS is_error
  FROM events
)"""


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a second look-up log: instance = order status, key = customer. It has more keys than
    the middle cache sizes, so the sizes differ."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice"])
    return o.select(
        F.col("o_orderstatus").alias("instance"), F.col("o_custkey").alias("key"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").cast("double").alias("op_ms"), F.lit(False).alias("is_error"),
    )


ORDERS_CTE = """
ev AS (
  SELECT o_orderstatus AS instance, o_custkey AS key, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS seq,
         CAST(o_totalprice AS DOUBLE) AS op_ms, false AS is_error
  FROM orders
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"


MODELS_CTE = "models AS (SELECT * FROM " + models_sql_values() + ")"

UPSERT_NOW = "2024-03-01 00:00:00"
STORED_AT = "2023-12-01 00:00:00"  # timestamps of the stored questions before the upsert


def question_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert records: English questions are looked up again (re-accesses with
    a new answer and no score), every QA user turn arrives as a new record."""
    q = questions(spark, sf_dir).filter(F.col("original_answer") == "en").select(
        "question_title", "question_content", "original_answer",
        F.concat(F.lit("updated:"), F.col("original_answer")).alias("llm_answer"),
        F.lit(None).cast("double").alias("quality_score"),
        _seq(0, F.col("id")).alias("seq"),
    )
    qa = qa_pairs(spark, sf_dir).select(
        "question_title", "question_content", F.lit("qa").alias("original_answer"),
        F.col("answer").alias("llm_answer"),
        F.when(F.col("answer").isNotNull(), F.lit(2.0)).alias("quality_score"),
        _seq(1, F.col("conv_id"), F.col("turn")).alias("seq"),
    )
    return q.unionByName(qa)


def _seq(source: int, *ids):
    """Arrival order of a record as text: its source, then its ids, filled to 20 digits."""
    return F.concat_ws(":", F.lit(str(source)), *[F.lpad(i.cast("string"), 20, "0") for i in ids])


RECORDS_CTE = """
records AS (
  SELECT question_title, question_content, original_answer, 'updated:' || original_answer AS llm_answer,
         CAST(NULL AS DOUBLE) AS quality_score, '0:' || lpad(CAST(id AS VARCHAR), 20, '0') AS seq
  FROM questions WHERE original_answer = 'en'
  UNION ALL
  SELECT question_title, question_content, 'qa' AS original_answer, answer AS llm_answer,
         CASE WHEN answer IS NOT NULL THEN 2.0 END AS quality_score,
         '1:' || lpad(CAST(conv_id AS VARCHAR), 20, '0') || ':' || lpad(CAST(turn AS VARCHAR), 20, '0') AS seq
  FROM qa
)"""
