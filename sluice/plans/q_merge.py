"""Registered queries: anti/semi/FK joins, upserts, write-back, limits, keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.functions.numeric import avg_rounded, avg_rounded_sql, round_ratio, round_ratio_sql, scaled
from sluice.operators import merge as M
from sluice.operators import scoring as SC
from sluice.operators.sequence import global_dense_id
from sluice.plans.q_scoring import BEST_SQL, UPSERT_RESULTS_SQL
from sluice.plans.registry import register
from sluice.schemas import models_dim
from sluice.session import scratch_path, write_table
from sluice.sources import bindings as B

MR = B.with_ctes(B.QA_CTE, B.MR_CTE, B.MODELS_CTE)
MRI = B.with_ctes(B.QA_CTE, B.MR_CTE, B.INCOMING_CTE)


@register("anti_unprocessed", MR + """
SELECT id FROM qa WHERE NOT EXISTS (SELECT 1 FROM mr WHERE mr.question_id = qa.id)""")
def anti_unprocessed(spark, sf):
    return M.anti_unprocessed(B.qa_pairs(spark, sf), B.model_results(spark, sf)).select("id")


@register("semi_processed", MR + """
SELECT id FROM qa WHERE EXISTS (SELECT 1 FROM mr WHERE mr.question_id = qa.id)""")
def semi_processed(spark, sf):
    return M.semi_processed(B.qa_pairs(spark, sf), B.model_results(spark, sf)).select("id")


@register("fk_join", MR + """
SELECT mr.question_id, mr.model_name, qa.question_title, qa.conv_id
FROM mr JOIN qa ON mr.question_id = qa.id""")
def fk_join(spark, sf):
    j = M.fk_join(B.model_results(spark, sf), B.qa_pairs(spark, sf))
    return j.select("question_id", "model_name", "question_title", "conv_id")


@register("distinct_ids", MR + "SELECT DISTINCT question_id FROM mr")
def distinct_ids(spark, sf):
    return M.distinct_ids(B.model_results(spark, sf))


@register("last_write_wins", MRI + """
SELECT question_id, model_name, answer, quality_score, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id, model_name ORDER BY created_at DESC, answer DESC) AS rn
  FROM (SELECT * FROM mr UNION ALL SELECT * FROM incoming)) WHERE rn = 1""")
def last_write_wins(spark, sf):
    rows = B.model_results(spark, sf).unionByName(B.incoming_results(spark, sf))
    return M.last_write_wins(rows, M.RESULT_KEY, "created_at", ["answer"]).select(
        "question_id", "model_name", "answer", "quality_score", "created_at")


@register("upsert_results", MRI + "," + UPSERT_RESULTS_SQL + " SELECT * FROM merged")
def upsert_results(spark, sf):
    return M.upsert_results(B.model_results(spark, sf), B.incoming_results(spark, sf))


@register("upsert_results_bucketed", MRI + "," + UPSERT_RESULTS_SQL + " SELECT * FROM merged")
def upsert_results_bucketed(spark, sf):
    """A stored table and two upserts into the buckets they touch: every other conversation first, then the rest."""
    name, path = f"sluice_results_{uuid.uuid4().hex}", scratch_path(spark, "results")
    M.create_result_table(B.model_results(spark, sf), name, path)
    incoming = write_table(B.incoming_results(spark, sf), "incoming")
    conv = F.split("question_id", ":")[0].cast("long")
    for rest in (0, 1):
        M.upsert_result_table(spark, name, incoming.where(conv % 2 == rest))
    spark.sql(f"DROP TABLE {name}")  # the files of a table with a path stay
    return spark.read.parquet(path).select(*M.RESULT_COLS)


@register("best_result_writeback", MR + "," + BEST_SQL + """
SELECT qa.id, b.best_answer AS llm_answer, coalesce(b.best_score, 1.0) AS quality_score
FROM qa LEFT JOIN best b ON b.question_id = qa.id""")
def best_result_writeback(spark, sf):
    best = SC.best_model_per_question(B.model_results(spark, sf), models_dim(spark))
    return M.best_result_writeback(B.qa_pairs(spark, sf), best)


@register("processing_summary", MR + "," + BEST_SQL + f"""
SELECT count(b.question_id) AS processed, count(*) AS total,
       coalesce({avg_rounded_sql('b.best_score', 2, 3)}, 0.0) AS avg_quality_score,
       coalesce(sum(t.cs), 0) / 100.0 AS seconds,
       {round_ratio_sql('count(b.question_id) * 100', 'coalesce(sum(t.cs), 0)', 3)} AS questions_per_second
FROM qa LEFT JOIN best b ON b.question_id = qa.id
LEFT JOIN (SELECT question_id, CAST(sum(CAST(round(response_time * 100) AS BIGINT)) AS BIGINT) AS cs FROM mr GROUP BY question_id) t ON t.question_id = qa.id""")
def processing_summary(spark, sf):
    """Processed and total questions, mean best score, model seconds and questions per model second."""
    results = B.model_results(spark, sf)
    best = SC.best_model_per_question(results, models_dim(spark))
    spent = results.groupBy(F.col("question_id").alias("id")).agg(F.sum(scaled(F.col("response_time"), 2)).alias("cs"))
    j = B.qa_pairs(spark, sf).join(best.withColumnRenamed("question_id", "id"), "id", "left").join(spent, "id", "left")
    g = j.agg(F.count("best_model").alias("processed"), F.count(F.lit(1)).alias("total"),
              F.coalesce(avg_rounded(F.col("best_score"), 2, 3), F.lit(0.0)).alias("avg_quality_score"),
              F.coalesce(F.sum("cs"), F.lit(0)).alias("cs"))
    return g.select("processed", "total", "avg_quality_score", (F.col("cs") / 100.0).alias("seconds"),
                    round_ratio(F.col("processed") * 100, F.col("cs"), 3).alias("questions_per_second"))


MAX_REQUESTS = 10000  # the reference's default request limit


@register("limit_requests", MR + f"""
SELECT id, CAST(count(*) OVER () AS BIGINT) AS total_available FROM (
  SELECT id, conv_id, turn FROM qa WHERE NOT EXISTS (SELECT 1 FROM mr WHERE mr.question_id = qa.id)
) ORDER BY conv_id, turn LIMIT {MAX_REQUESTS}""")
def limit_requests(spark, sf):
    todo = M.anti_unprocessed(B.qa_pairs(spark, sf), B.model_results(spark, sf)).select("id", "conv_id", "turn")
    return M.limit_requests(todo, MAX_REQUESTS)


UPSERT_QUESTION_SQL = B.with_ctes(B.QUESTIONS_CTE, B.QA_CTE, B.RECORDS_CTE) + f"""
, inc AS (
  SELECT question_title, question_content, count(*) AS n_records,
         arg_max(llm_answer, seq) FILTER (WHERE llm_answer IS NOT NULL AND llm_answer <> '') AS new_answer,
         arg_max(quality_score, seq) FILTER (WHERE quality_score IS NOT NULL) AS new_score,
         arg_min(original_answer, seq) AS new_original, min(seq) AS first_seq
  FROM records GROUP BY question_title, question_content
), firsts AS (
  SELECT question_title, question_content, min(id) AS first_id FROM questions GROUP BY question_title, question_content
), m AS (
  SELECT inc.*, f.first_id FROM inc LEFT JOIN firsts f
    ON f.question_title IS NOT DISTINCT FROM inc.question_title
   AND f.question_content IS NOT DISTINCT FROM inc.question_content
), upd AS (
  SELECT first_id AS id, n_records, new_answer, new_score FROM m WHERE first_id IS NOT NULL
)
SELECT q.id, q.question_title, q.question_content, q.original_answer,
       CASE WHEN u.n_records IS NOT NULL AND u.new_answer IS NOT NULL AND u.new_answer <> '' THEN u.new_answer
            ELSE q.llm_answer END AS llm_answer,
       CASE WHEN u.n_records IS NOT NULL THEN coalesce(u.new_score, q.quality_score) ELSE q.quality_score END AS quality_score,
       CAST(q.access_count + coalesce(u.n_records, 0) AS INTEGER) AS access_count,
       q.original_class,
       TIMESTAMP '{B.STORED_AT}' AS created_at,
       CASE WHEN u.n_records IS NOT NULL THEN TIMESTAMP '{B.UPSERT_NOW}' ELSE TIMESTAMP '{B.STORED_AT}' END AS updated_at,
       TIMESTAMP '{B.STORED_AT}' AS first_access,
       CASE WHEN u.n_records IS NOT NULL THEN TIMESTAMP '{B.UPSERT_NOW}' ELSE TIMESTAMP '{B.STORED_AT}' END AS last_access
FROM questions q LEFT JOIN upd u USING (id)
UNION ALL
SELECT (SELECT coalesce(max(id), 0) FROM questions)
         + row_number() OVER (ORDER BY first_seq) AS id,
       question_title, question_content, new_original, new_answer, new_score, CAST(n_records AS INTEGER),
       CAST(NULL AS INTEGER), TIMESTAMP '{B.UPSERT_NOW}', TIMESTAMP '{B.UPSERT_NOW}', TIMESTAMP '{B.UPSERT_NOW}', TIMESTAMP '{B.UPSERT_NOW}'
FROM m WHERE first_id IS NULL"""


@register("upsert_question", UPSERT_QUESTION_SQL)
def upsert_question(spark, sf):
    now = F.lit(B.UPSERT_NOW).cast("timestamp_ntz")
    stored = B.counted_questions(spark, sf)
    for c in M.QUESTION_TIMES:
        stored = stored.withColumn(c, F.lit(B.STORED_AT).cast("timestamp_ntz"))
    return M.upsert_questions(stored, B.question_records(spark, sf), now)


@register("surrogate_key", B.with_ctes(B.QUESTIONS_CTE) + """
SELECT row_number() OVER (ORDER BY question_title, id) AS serial_id, id FROM questions""")
def surrogate_key(spark, sf):
    q = B.questions(spark, sf).select("id", "question_title")
    return global_dense_id(q, ["question_title", "id"], id_col="serial_id").select("serial_id", "id")


@register("conditional_overwrite", "SELECT id, llm_answer, quality_score FROM (" + UPSERT_QUESTION_SQL + ")")
def conditional_overwrite(spark, sf):
    """Answer taken only when truthy, score only when not NULL (batch upsert)."""
    return upsert_question(spark, sf).select("id", "llm_answer", "quality_score")


@register("touch_updated_at", "SELECT id, updated_at, created_at FROM (" + UPSERT_QUESTION_SQL + ")")
def touch_updated_at(spark, sf):
    """Rows changed by the upsert carry the (parameterised) update clock, the others keep theirs."""
    return upsert_question(spark, sf).select("id", "updated_at", "created_at")
