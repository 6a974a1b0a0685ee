"""Registered queries: retention, sampling/workload tables and ingest paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import scoring as S
from sluice.operators import access as A
from sluice.operators import retention as RT
from sluice.operators import sampling as SP
from sluice.plans.q_access import SEQ_CTES, anchors_ctes, rec
from sluice.plans.registry import register
from sluice.session import scratch_path
from sluice.sources import bindings as B
from sluice.sources import ingest as IN

Q = B.with_ctes(B.QUESTIONS_CTE)
INGEST_NOW = "2024-01-01 00:00:00"


# ---------------------------------------------------------------------------
# retention

def _evict_sql(ttl_seconds: int, cap: int, min_one: bool) -> str:
    ttl_us = ttl_seconds * 1_000_000
    k = "greatest(1, floor(z.n * 0.1))" if min_one else "floor(z.n * 0.1)"
    rem = lambda c: f"CAST(floor((epoch_us({c}) + {ttl_us} - epoch_us(now)) / 1000000) AS BIGINT)"
    return rec(B.EV_CTE, anchors_ctes(ttl_seconds, "fa")) + f"""
, nowt AS (SELECT max(ts) AS now FROM ev)
, pk AS (SELECT instance, key, count(*) AS accesses, max(ts) AS last_access FROM ev GROUP BY instance, key)
, ls AS (SELECT fa.instance, fa.key, max(e.ts) AS last_set FROM fa JOIN ev e
           ON e.instance = fa.instance AND e.key = fa.key AND e.seq = fa.seq GROUP BY fa.instance, fa.key)
, base AS (SELECT pk.*, ls.last_set, nowt.now FROM pk LEFT JOIN ls USING (instance, key) CROSS JOIN nowt)
, snap AS (
  SELECT instance, key, 'LRU' AS policy,
         CASE WHEN accesses > 1 THEN {rem('last_access')} ELSE -1 END AS ttl FROM base
  UNION ALL SELECT instance, key, 'TTL', {rem('last_set')} FROM base
  UNION ALL SELECT instance, key, 'TTL-LRU', {rem('last_access')} FROM base
)
, alive AS (SELECT * FROM snap WHERE ttl = -1 OR ttl > 0)
, scored AS (SELECT *, CASE WHEN policy = 'TTL-LRU' THEN CASE WHEN ttl > 0 THEN ttl ELSE {RT.LAST_RESORT} END
                            WHEN policy = 'TTL' THEN CASE WHEN ttl > 0 THEN ttl END ELSE ttl END AS score FROM alive)
, sizes AS (SELECT policy, instance, count(*) AS n FROM alive GROUP BY policy, instance)
, ranked AS (SELECT s.*, row_number() OVER (PARTITION BY policy, instance ORDER BY score, key) AS rank
             FROM scored s WHERE score IS NOT NULL)
SELECT r.policy, r.instance, r.key, r.ttl, r.score, r.rank, z.n AS cache_size_before,
       CASE r.policy {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in RT.REASONS.items())} END AS reason
FROM ranked r JOIN sizes z USING (policy, instance)
WHERE r.rank <= CASE WHEN z.n >= {cap} THEN {k} ELSE 0 END"""


def _evict(spark, sf, ttl_seconds: int, cap: int, min_one: bool):
    log = B.access_log(spark, sf)
    anchors = A.fixed_ttl_anchors(log, ttl_seconds)
    last_set = (anchors.join(log.select("instance", "key", "seq", "ts"), ["instance", "key", "seq"])
                .groupBy("instance", "key").agg(F.max("ts").alias("last_set")))
    now = log.agg(F.max("ts").alias("now"))  # one row
    snap = RT.cache_snapshot(log.crossJoin(now), ttl_seconds, F.col("now"), last_set)
    return RT.evict_candidates(snap, cap, min_one)


@register("evict_candidates", _evict_sql(7 * 86400, 100, True))
def evict_candidates(spark, sf):
    return _evict(spark, sf, 7 * 86400, 100, True)


@register("evict_candidates_floor", _evict_sql(86400, 5, False))
def evict_candidates_floor(spark, sf):
    return _evict(spark, sf, 86400, 5, False)


HISTORY_SIZE = 10


@register("recent_history", B.with_ctes(B.EV_CTE, SEQ_CTES) + f"""
, d AS (SELECT s.*, rd.reuse_distance FROM seql s LEFT JOIN rd ON rd.instance = s.instance AND rd.pos = s.pos)
, f AS (SELECT instance, max(pos) AS full_at FROM (
    SELECT instance, pos, row_number() OVER (PARTITION BY instance ORDER BY pos) AS n FROM d WHERE reuse_distance IS NULL)
  WHERE n <= {HISTORY_SIZE} GROUP BY instance HAVING count(*) = {HISTORY_SIZE})
SELECT instance, key, seq, ts, '{RT.REASONS["LRU"]}' AS reason, 1 AS evicted_count, {HISTORY_SIZE} AS size_before,
       CAST(recency_rank AS INTEGER) AS recency_rank FROM (
  SELECT d.*, row_number() OVER (PARTITION BY d.instance ORDER BY ts DESC, seq DESC) AS recency_rank
  FROM d JOIN f ON f.instance = d.instance AND d.pos > f.full_at
  WHERE reuse_distance IS NULL OR reuse_distance >= {HISTORY_SIZE}) WHERE recency_rank <= 10""")
def recent_history(spark, sf):
    """The last 10 evictions of each cache instance of 10 keys."""
    s = A.sequence_log(B.access_log(spark, sf))
    top = RT.recent_history(RT.eviction_events(A.reuse_distance(s), s, HISTORY_SIZE), ["instance"], "ts", k=10)
    return top.select("instance", "key", "seq", "ts", "reason", "evicted_count", "size_before", "recency_rank")


# ---------------------------------------------------------------------------
# sampling and workload tables

DRAWS = 10_000  # the default number of draws


@register("sample_with_replacement", Q + f""", items AS (SELECT id, row_number() OVER (ORDER BY id) AS idx FROM questions),
draws AS (SELECT CAST(floor(CAST(('0x' || substr(md5('42:' || j), 1, 8)) AS BIGINT) / 4294967296.0 * (SELECT count(*) FROM questions)) + 1 AS BIGINT) AS target
          FROM (SELECT range AS j FROM range(0, {DRAWS})))
SELECT i.id AS drawn_id, count(*) AS times_drawn FROM draws d JOIN items i ON i.idx = d.target GROUP BY i.id""")
def sample_with_replacement(spark, sf):
    d = SP.sample_with_replacement(B.questions(spark, sf).select("id"), DRAWS, 42)
    return d.groupBy("drawn_id").agg(F.count(F.lit(1)).alias("times_drawn"))


WEIGHT_SCALE = 1_000_000_000


def _weighted_sql(items: str, seed: int, scale: int) -> str:
    """Draws by places in the row of weights; ``items`` has id and w."""
    return Q + f""", {items},
units AS (SELECT id, CAST(floor(CAST(w AS DECIMAL(28,10)) * {scale}) AS BIGINT) AS u FROM weighted),
spans AS (SELECT id, u, sum(u) OVER (ORDER BY id) AS upto FROM units WHERE u > 0),
draws AS (SELECT CAST((CAST({S.hash60_sql(f"'{seed}:' || j")} AS HUGEINT) * (SELECT max(upto) FROM spans)) // {S.SPACE} AS BIGINT) AS place
          FROM (SELECT range AS j FROM range(0, {DRAWS})))
SELECT s.id AS drawn_id, count(*) AS times_drawn FROM draws d JOIN spans s ON d.place < s.upto AND d.place >= s.upto - s.u GROUP BY s.id"""


@register("weighted_sample", _weighted_sql("""items AS (SELECT id, row_number() OVER (ORDER BY id) AS idx, count(*) OVER () AS n FROM questions),
weighted AS (SELECT id, CASE WHEN idx <= 50 THEN 0.8::DOUBLE / least(n, 50) ELSE 0.2::DOUBLE / (n - 50) END AS w FROM items)""", 7, WEIGHT_SCALE))
def weighted_sample(spark, sf):
    """The 80/20 workload: the weights of ``union_workload``."""
    d = SP.weighted_sample(SP.union_workload(B.questions(spark, sf).select("id")), DRAWS, "weight", 7, scale=WEIGHT_SCALE)
    return d.groupBy("drawn_id").agg(F.count(F.lit(1)).alias("times_drawn"))


@register("weighted_sample_quality", _weighted_sql("weighted AS (SELECT id, quality_score AS w FROM questions)", 8, 1_000_000))
def weighted_sample_quality(spark, sf):
    """Weights of a column of the data: the quality score, null or 0 for many questions, which are never drawn."""
    d = SP.weighted_sample(B.questions(spark, sf).select("id", "quality_score"), DRAWS, "quality_score", 8)
    return d.groupBy("drawn_id").agg(F.count(F.lit(1)).alias("times_drawn"))


@register("union_workload", Q + """, items AS (SELECT id, row_number() OVER (ORDER BY id) AS idx FROM questions),
nn AS (SELECT count(*) AS n FROM questions)
SELECT id, 'frequent' AS kind, 0.8 / least(n, 50) AS weight FROM items CROSS JOIN nn WHERE idx <= 50
UNION ALL
SELECT id, 'rare' AS kind, 0.2 / (n - 50) AS weight FROM items CROSS JOIN nn WHERE idx > 50""")
def union_workload(spark, sf):
    return SP.union_workload(B.questions(spark, sf).select("id"))


# ---------------------------------------------------------------------------
# ingest

RAW_COLS = ["original_class", "question_title", "question_content", "original_answer"]
NA_LIST = ", ".join("'" + s.replace("'", "''") + "'" for s in IN.PANDAS_NA_STRINGS)


def _na_fill_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} IN ({NA_LIST}) THEN '' ELSE {c} END"


RAW_SQL = Q + f"""
SELECT original_class, {_na_fill_sql('question_title')} AS question_title,
       {_na_fill_sql('question_content')} AS question_content, {_na_fill_sql('original_answer')} AS original_answer
FROM questions"""


def _csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    IN.write_headerless_csv(B.questions(spark, sf).select(*RAW_COLS), path)
    return IN.fill_string_nulls(IN.csv_headerless_scan(spark, path))


@register("csv_headerless_scan", RAW_SQL)
def csv_headerless_scan(spark, sf):
    return _csv_roundtrip(spark, sf)


@register("column_defaults", Q + f"""
SELECT original_class, {_na_fill_sql('question_title')} AS question_title,
       {_na_fill_sql('question_content')} AS question_content, {_na_fill_sql('original_answer')} AS original_answer,
       CAST(NULL AS VARCHAR) AS llm_answer, 0.0::DOUBLE AS quality_score, 1 AS access_count,
       TIMESTAMP '{INGEST_NOW}' AS created_at, TIMESTAMP '{INGEST_NOW}' AS updated_at,
       TIMESTAMP '{INGEST_NOW}' AS first_access, TIMESTAMP '{INGEST_NOW}' AS last_access
FROM questions""")
def column_defaults(spark, sf):
    return IN.column_defaults(_csv_roundtrip(spark, sf), F.lit(INGEST_NOW).cast("timestamp_ntz"))


@register("idempotent_load", Q + "SELECT true AS first_load, false AS second_load, count(*) AS rows FROM questions")
def idempotent_load(spark, sf):
    path = scratch_path(spark, "load")
    q = B.questions(spark, sf)
    first = IN.idempotent_load(q, path)
    second = IN.idempotent_load(q, path)
    n = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
    return n.select(F.lit(first).alias("first_load"), F.lit(second).alias("second_load"), "rows")


@register("incremental_load", Q + """
SELECT (SELECT count(*) FROM questions WHERE original_class IS NOT NULL) AS first_rows,
       (SELECT count(*) FROM questions WHERE original_class IS NULL) AS added_rows, 0::BIGINT AS repeated_rows, count(*) AS rows, sum(id)::BIGINT AS id_sum FROM questions""")
def incremental_load(spark, sf):
    """A first load, one of all rows that adds the missing ones, and a repetition that adds none."""
    path = scratch_path(spark, "increments")
    q = B.questions(spark, sf)
    first = IN.incremental_load(q.where(F.col("original_class").isNotNull()), path, "id")
    added, again = IN.incremental_load(q, path, "id"), IN.incremental_load(q, path, "id")
    n = IN.loaded(spark, path, q.schema).agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("id_sum"))
    return n.select(*[F.lit(v).cast("long").alias(c) for c, v in (("first_rows", first), ("added_rows", added), ("repeated_rows", again))], "rows", "id_sum")


@register("batch_append_sink", Q + "SELECT * FROM questions")
def batch_append_sink(spark, sf):
    path = scratch_path(spark, "append")
    IN.batch_append_sink(B.counted_questions(spark, sf), path, files=4)
    return spark.read.parquet(path)


@register("load_row_limit", Q + "SELECT * FROM questions ORDER BY id LIMIT 5000")
def load_row_limit(spark, sf):
    # the reference keeps the first 5,000 rows of its CSV: the limit is the feature
    return IN.load_row_limit(B.counted_questions(spark, sf), 5000, ["id"])


@register("load_reconcile", Q + """
SELECT count(*) AS source_rows, count(*) AS target_rows, true AS match FROM questions""")
def load_reconcile(spark, sf):
    path = scratch_path(spark, "reconcile")
    q = B.questions(spark, sf)
    IN.batch_append_sink(q, path)
    return IN.load_reconcile(q, spark.read.parquet(path))
