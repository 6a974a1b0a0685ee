"""Registered queries: projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import json as J
from sluice.functions import numeric as N
from sluice.functions import predicates as P
from sluice.functions import scoring as S
from sluice.functions import text as X
from sluice.plans.registry import register
from sluice.schemas import DEFAULT_ANSWER, DEFAULT_CACHED_SCORE
from sluice.sources import bindings as B

Q = B.with_ctes(B.QUESTIONS_CTE)
QA = B.with_ctes(B.QA_CTE)
EV = B.with_ctes(B.EV_CTE)


@register("content_key", Q + f"""
SELECT id, {X.content_key_sql('question_title', 'question_content')} AS content_key FROM questions""")
def content_key(spark, sf):
    q = B.questions(spark, sf)
    return q.select("id", X.content_key(F.col("question_title"), F.col("question_content")).alias("content_key"))


@register("categorize_text", Q + f"""
SELECT id, {X.categorize_text_sql('question_title', 'question_content')} AS category FROM questions""")
def categorize_text(spark, sf):
    q = B.questions(spark, sf)
    return q.select("id", X.categorize_text(F.col("question_title"), F.col("question_content")).alias("category"))


@register("extract_keywords", Q + f"""
SELECT id, array_to_string(kw, '|') AS keywords, CAST(len(kw) AS INTEGER) AS n_keywords
FROM (SELECT id, {X.extract_keywords_sql("question_title || ' ' || question_content")} AS kw FROM questions)""")
def extract_keywords(spark, sf):
    q = B.questions(spark, sf)
    kw = X.extract_keywords(F.concat_ws(" ", "question_title", "question_content"))
    return q.select("id", kw.alias("kw")).select(
        "id", F.array_join("kw", "|").alias("keywords"), F.size("kw").alias("n_keywords"))


@register("extract_topic", QA + f"SELECT id, {X.topic_sql('question_title')} AS topic FROM qa")
def extract_topic(spark, sf):
    return B.qa_pairs(spark, sf).select("id", X.extract_topic(F.col("question_title")).alias("topic"))


@register("template_text", B.with_ctes(B.QA_CTE, B.MR_CTE) + """
SELECT question_id, model_name, answer FROM mr""")
def template_text(spark, sf):
    return B.model_results(spark, sf).select("question_id", "model_name", "answer")


@register("token_count", QA + f"""
SELECT id, CAST({X.token_count_sql('answer')} AS INTEGER) AS token_count, CAST(length(answer) AS INTEGER) AS char_count FROM qa""")
def token_count(spark, sf):
    qa = B.qa_pairs(spark, sf)
    return qa.select("id", X.token_count(F.col("answer")).alias("token_count"),
                     X.char_count(F.col("answer")).alias("char_count"))


@register("char_count", B.with_ctes(B.QA_CTE, B.MR_CTE) + f"""
SELECT question_id, model_name, CAST(length(answer) AS INTEGER) AS char_count, CAST({X.token_count_sql('answer')} AS INTEGER) AS token_count FROM mr""")
def char_count(spark, sf):
    mr = B.model_results(spark, sf)
    return mr.select("question_id", "model_name", X.char_count(F.col("answer")).alias("char_count"),
                     X.token_count(F.col("answer")).alias("token_count"))


@register("hash_bucket", QA + f"""
SELECT id, {S.hash_bucket_sql("question_title || chr(10) || coalesce(question_content, '')")} AS bucket FROM qa""")
def hash_bucket(spark, sf):
    qa = B.qa_pairs(spark, sf)
    return qa.select("id", S.hash_bucket(S.score_input(F.col("question_title"), F.col("question_content"))).alias("bucket"))


@register("hash_score", B.with_ctes(B.QA_CTE, B.MR_CTE) + "SELECT question_id, model_name, quality_score FROM mr")
def hash_score(spark, sf):
    return B.model_results(spark, sf).select("question_id", "model_name", "quality_score")


@register("score_input", QA + """
SELECT id, md5(question_title || chr(10) || coalesce(question_content, '')) AS input_md5,
       CAST(length(question_title || chr(10) || coalesce(question_content, '')) AS INTEGER) AS input_len FROM qa""")
def score_input(spark, sf):
    qa = B.qa_pairs(spark, sf)
    x = S.score_input(F.col("question_title"), F.col("question_content"))
    return qa.select("id", F.md5(x).alias("input_md5"), F.length(x).alias("input_len"))


@register("safe_ratio_pct", EV + f"""
SELECT instance, count(*) AS ops, count(CASE WHEN is_error THEN 1 END) AS errors,
       round(CASE WHEN count(*) > 0 THEN count(CASE WHEN is_error THEN 1 END) / count(*) * 100 ELSE 0.0 END, 6) AS error_pct,
       round(CASE WHEN count(CASE WHEN is_error THEN 1 END) > 0 THEN count(*) / count(CASE WHEN is_error THEN 1 END) * 100 ELSE 0.0 END, 6) AS ops_per_error_pct
FROM ev GROUP BY instance""")
def safe_ratio_pct(spark, sf):
    """Percentages that are 0 where the divisor is 0 (instances without errors)."""
    ev = B.access_log(spark, sf)
    g = ev.groupBy("instance").agg(F.count(F.lit(1)).alias("ops"), F.count_if("is_error").alias("errors"))
    return g.select("instance", "ops", "errors", F.round(N.safe_ratio_pct(F.col("errors"), F.col("ops")), 6).alias("error_pct"),
                    F.round(N.safe_ratio_pct(F.col("ops"), F.col("errors")), 6).alias("ops_per_error_pct"))


@register("qps", EV + """
SELECT instance, count(*) AS ops,
       round(CASE WHEN max(epoch_us(ts)) > min(epoch_us(ts))
                  THEN count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0) ELSE 0.0 END, 6) AS qps
FROM ev GROUP BY instance""")
def qps(spark, sf):
    ev = B.access_log(spark, sf).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    g = ev.groupBy("instance").agg(F.count(F.lit(1)).alias("ops"), F.min("us").alias("lo"), F.max("us").alias("hi"))
    return g.select("instance", "ops",
                    F.round(N.qps(F.col("ops"), (F.col("hi") - F.col("lo")) / 1000000.0), 6).alias("qps"))


@register("elapsed_ms", EV + """
SELECT instance, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000.0 AS span_ms FROM ev GROUP BY instance""")
def elapsed_ms(spark, sf):
    ev = B.access_log(spark, sf)
    g = ev.groupBy("instance").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.select("instance", N.elapsed_ms(F.col("a"), F.col("b")).alias("span_ms"))


@register("iso_timestamp", EV + f"""
SELECT seq, {N.iso_timestamp_sql('ts')} AS iso_ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS report_ts FROM ev""")
def iso_timestamp(spark, sf):
    ev = B.access_log(spark, sf)
    return ev.select("seq", N.iso_timestamp(F.col("ts")).alias("iso_ts"), N.report_timestamp(F.col("ts")).alias("report_ts"))


@register("text_truncate", Q + f"""
SELECT id, left(question_title, 50) AS title50, left(question_content, 100) AS content100,
       left({X.content_key_sql('question_title', 'question_content')}, 16) AS key16 FROM questions""")
def text_truncate(spark, sf):
    q = B.questions(spark, sf)
    return q.select("id", X.text_truncate(F.col("question_title"), 50).alias("title50"),
                    X.text_truncate(F.col("question_content"), 100).alias("content100"),
                    X.text_truncate(X.content_key(F.col("question_title"), F.col("question_content")), 16).alias("key16"))


@register("format_metric", EV + f"""
SELECT instance, printf('%.2f%%', {N.round_ratio_sql('count(CASE WHEN is_error THEN 1 END) * 100', 'count(*)', 2)}) AS error_pct_text,
       format('{{:,}}', count(*)) AS ops_text
FROM ev GROUP BY instance""")
def format_metric(spark, sf):
    ev = B.access_log(spark, sf)
    g = ev.groupBy("instance").agg(F.count(F.lit(1)).alias("ops"), F.count_if("is_error").alias("errors"))
    return g.select("instance", N.format_pct(N.round_ratio(F.col("errors") * 100, F.col("ops"), 2)).alias("error_pct_text"),
                    N.format_thousands(F.col("ops")).alias("ops_text"))


@register("json_decode", B.with_ctes(B.EV_CTE) + """
SELECT event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_decode(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props")
    return ev.select(F.col("event_id").alias("seq"), J.json_decode(F.col("props"), J.PROPS_SCHEMA)["k"].alias("k"))


@register("json_encode", """
SELECT event_id AS seq, CAST(to_json(struct_pack(event_type := event_type, k := CAST(json_extract(props, '$.k') AS BIGINT), v := value)) AS VARCHAR) AS payload
FROM events""")
def json_encode(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "props", "value")
    k = J.json_decode(F.col("props"), J.PROPS_SCHEMA)["k"]
    return ev.select(F.col("event_id").alias("seq"),
                     J.json_encode(F.col("event_type"), k.alias("k"), F.col("value").alias("v")).alias("payload"))


@register("json_counter_update", """
SELECT event_id AS seq,
       CAST(to_json(struct_pack(k := CAST(json_extract(props, '$.k') AS BIGINT),
                                access_count := coalesce(CAST(json_extract(props, '$.access_count') AS BIGINT), 1) + 1,
                                last_accessed := strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'))) AS VARCHAR) AS payload
FROM events""")
def json_counter_update(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props", "ts")
    schema = J.PROPS_SCHEMA.add("access_count", "long").add("last_accessed", "string")
    return ev.select(F.col("event_id").alias("seq"),
                     J.json_counter_update(F.col("props"), F.col("ts"), schema).alias("payload"))


@register("modulo_content", """
SELECT event_id AS seq, 'contenido ' || CAST(event_id % 100 AS VARCHAR) AS content FROM events""")
def modulo_content(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id")
    return ev.select(F.col("event_id").alias("seq"), P.modulo_content(F.col("event_id")).alias("content"))


@register("falsy_default", Q + f"""
SELECT id,
       {P.falsy_default_sql('quality_score', str(DEFAULT_CACHED_SCORE))} AS cached_score,
       {P.falsy_default_sql('llm_answer', "'" + DEFAULT_ANSWER + "'", 'text')} AS cached_answer,
       coalesce(question_content, '') AS content_or_empty
FROM questions""")
def falsy_default(spark, sf):
    q = B.questions(spark, sf)
    return q.select("id",
                    P.falsy_default(F.col("quality_score"), DEFAULT_CACHED_SCORE).alias("cached_score"),
                    P.falsy_default(F.col("llm_answer"), DEFAULT_ANSWER, "text").alias("cached_answer"),
                    P.falsy_default(F.col("question_content"), "", "text").alias("content_or_empty"))


@register("fill_nulls", Q + """
SELECT id, coalesce(question_title, '') AS question_title, coalesce(question_content, '') AS question_content,
       coalesce(original_answer, '') AS original_answer, coalesce(llm_answer, '') AS llm_answer,
       quality_score, access_count, original_class
FROM questions""")
def fill_nulls(spark, sf):
    # pandas fillna('') on the joined frame: only the string columns take ''
    return B.counted_questions(spark, sf).na.fill("")


@register("filter_unprocessed", Q + "SELECT id FROM questions WHERE llm_answer IS NULL OR llm_answer = ''")
def filter_unprocessed(spark, sf):
    return B.questions(spark, sf).filter(P.is_unprocessed(F.col("llm_answer"))).select("id")


@register("processed_flag", Q + "SELECT id, llm_answer IS NOT NULL AS processed FROM questions")
def processed_flag(spark, sf):
    return B.questions(spark, sf).select("id", P.is_processed(F.col("llm_answer")).alias("processed"))


@register("positive_only", Q + """
SELECT original_class, count(CASE WHEN quality_score > 0 THEN quality_score END) AS n_positive,
       sum(CASE WHEN quality_score > 0 THEN quality_score END) AS sum_positive
FROM questions GROUP BY original_class""")
def positive_only(spark, sf):
    q = B.questions(spark, sf)
    pos = P.positive_only(F.col("quality_score"))
    return q.groupBy("original_class").agg(F.count(pos).alias("n_positive"), F.sum(pos).alias("sum_positive"))


@register("threshold_flag", B.with_ctes(B.QA_CTE, B.MR_CTE) + """
SELECT question_id, model_name, quality_score >= 2.5 AS high_quality FROM mr""")
def threshold_flag(spark, sf):
    mr = B.model_results(spark, sf)
    return mr.select("question_id", "model_name", P.high_quality(F.col("quality_score")).alias("high_quality"))


@register("null_safe_match", Q + """
, records AS (
  SELECT DISTINCT question_title, nullif(question_content, '') AS question_content FROM questions
  WHERE llm_answer IS NOT NULL
)
SELECT q.id, r.question_title IS NOT NULL AS matched
FROM questions q LEFT JOIN records r
  ON q.question_title IS NOT DISTINCT FROM r.question_title
 AND nullif(q.question_content, '') IS NOT DISTINCT FROM r.question_content""")
def null_safe_match(spark, sf):
    """Matches on (title, content) with NULL equal to NULL, by a 16-byte null-safe key instead of the texts."""
    q = B.questions(spark, sf).withColumn("question_content", F.nullif(F.col("question_content"), F.lit("")))
    q = q.select("id", "llm_answer", X.pair_key(F.col("question_title"), F.col("question_content")).alias("k"))
    rec = q.filter(F.col("llm_answer").isNotNull()).select("k").distinct().withColumn("hit", F.lit(True))
    j = q.join(rec, P.null_safe_match(q, rec, ["k"]), "left")
    return j.select(q["id"], F.coalesce(rec["hit"], F.lit(False)).alias("matched"))


@register("rating_bands", B.with_ctes(B.EV_CTE) + f"""
, pk AS (SELECT instance, key, count(*) AS c FROM ev GROUP BY instance, key)
, h AS (SELECT instance, {N.round_ratio_sql('(sum(c) - count(*)) * 100', 'sum(c)', 2)} AS hit_rate FROM pk GROUP BY instance)
, l AS (SELECT instance, {N.avg_rounded_sql('op_ms', 2, 2)} AS latency_ms, {N.round_ratio_sql('count(CASE WHEN NOT is_error THEN 1 END) * 1000', 'count(*)', 2)} / 100 AS quality
        FROM ev GROUP BY instance)
SELECT instance, hit_rate, CASE WHEN hit_rate > 70.0 THEN 'excellent' ELSE 'needs_improvement' END AS hit_band,
       latency_ms, CASE WHEN latency_ms < 100.0 THEN 'optimal' ELSE 'slow' END AS latency_band,
       quality, CASE WHEN quality > 8.0 THEN 'high' ELSE 'standard' END AS quality_band
FROM h JOIN l USING (instance)""")
def rating_bands(spark, sf):
    """Bands per cache instance: hit rate of an unbounded cache, mean operation time, and successful operations
    on a scale of ten."""
    log = B.access_log(spark, sf)
    per_key = log.groupBy("instance", "key").agg(F.count(F.lit(1)).alias("c"))
    hits = per_key.groupBy("instance").agg(F.sum("c").alias("ops"), F.count(F.lit(1)).alias("keys")).select(
        "instance", N.round_ratio((F.col("ops") - F.col("keys")) * 100, F.col("ops"), 2).alias("hit_rate"))
    rest = log.groupBy("instance").agg(
        N.avg_rounded(F.col("op_ms"), 2, 2).alias("latency_ms"), F.count(F.lit(1)).alias("ops"), F.count_if(~F.col("is_error")).alias("good")).select(
        "instance", "latency_ms", (N.round_ratio(F.col("good") * 1000, F.col("ops"), 2) / 100).alias("quality"))
    j = hits.join(rest, "instance")
    return j.select("instance", "hit_rate", P.rating_band("hit_rate", F.col("hit_rate")).alias("hit_band"),
                    "latency_ms", P.rating_band("latency_ms", F.col("latency_ms")).alias("latency_band"),
                    "quality", P.rating_band("quality", F.col("quality")).alias("quality_band"))
