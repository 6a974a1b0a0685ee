"""Joins and keyed merges: anti/semi joins, write-back and upserts.

Parquet has no row-level MERGE; an upsert is a ``full_outer`` join on the key
with per-column choice, written to a new version directory by the sink. The
keys (question_id, model_name) are unique per side after de-duplication, so
the join has no hot key; the incoming de-duplication is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.predicates import conditional_overwrite_text, conditional_overwrite_value
from sluice.functions.text import pair_key
from sluice.operators.sequence import global_dense_id
from sluice.schemas import FAILURE_SCORE

RESULT_KEY = ["question_id", "model_name"]
RESULT_COLS = ["question_id", "model_name", "model_provider", "answer", "quality_score", "response_time",
               "cost_tier", "created_at"]


def anti_unprocessed(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Questions without any result row (``NOT EXISTS``; a NULL question_id never matches)."""
    return questions.join(results.select(F.col("question_id").alias("id")), "id", "left_anti")


def limit_requests(todo: DataFrame, n: int) -> DataFrame:
    """The first ``n`` questions to do by conversation and turn (by id, if they have neither), with how many there are."""
    total = todo.agg(F.count(F.lit(1)).alias("total_available"))
    order = [c for c in ("conv_id", "turn") if c in todo.columns] or ["id"]
    return todo.orderBy(*order).limit(n).select("id").crossJoin(total)  # total is one row


def semi_processed(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Questions with at least one result row (one set-based semi join, no N+1)."""
    return questions.join(results.select(F.col("question_id").alias("id")), "id", "left_semi")


def fk_join(results: DataFrame, questions: DataFrame) -> DataFrame:
    return results.join(questions.withColumnRenamed("id", "question_id"), "question_id", "inner")


def distinct_ids(results: DataFrame) -> DataFrame:
    return results.select("question_id").distinct()


def last_write_wins(rows: DataFrame, key: list[str], order_col: str = "created_at",
                    tie_cols: list[str] | None = None) -> DataFrame:
    """Keep the latest row per key (max_by, partially aggregated before the shuffle)."""
    others = [c for c in rows.columns if c not in key]
    order = F.struct(F.col(order_col), *[F.col(c) for c in (tie_cols or [])])
    g = rows.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return g.select(*key, *[F.col(f"_r.{c}").alias(c) for c in others])


def upsert_results(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """INSERT ... ON CONFLICT (question_id, model_name) DO UPDATE answer, quality_score,
    response_time, created_at. Provider and cost tier keep their old values."""
    # a NULL key part is no conflict (UNIQUE treats NULLs as distinct): such rows are inserted as they are
    whole = F.col("question_id").isNotNull() & F.col("model_name").isNotNull()
    incoming = incoming.select(*RESULT_COLS)
    new = last_write_wins(incoming.filter(whole), RESULT_KEY, "created_at", ["answer"]).unionByName(incoming.filter(~whole))
    o = existing.select(*RESULT_COLS, F.lit(True).alias("_old")).alias("o")
    n = new.withColumn("_new", F.lit(True)).alias("n")
    j = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in RESULT_KEY], "full_outer")
    matched_new, has_old = F.col("n._new").isNotNull(), F.col("o._old").isNotNull()

    def pick_new(c: str) -> Column:
        return F.when(matched_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    def keep_old(c: str) -> Column:
        return F.when(has_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    return j.select(
        F.coalesce(F.col("o.question_id"), F.col("n.question_id")).alias("question_id"),
        F.coalesce(F.col("o.model_name"), F.col("n.model_name")).alias("model_name"),
        keep_old("model_provider"), pick_new("answer"), pick_new("quality_score"), pick_new("response_time"),
        keep_old("cost_tier"), pick_new("created_at"),
    )


#: Folders and hash buckets of a stored result table.
SHARDS, BUCKETS = 16, 8


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("question_id"), F.lit(shards)).cast("int").alias("shard")


def create_result_table(results: DataFrame, name: str, path: str, shards: int = SHARDS, buckets: int = BUCKETS) -> None:
    """Store results as table ``name`` at ``path``: a folder for each hash shard of the question, in it hash buckets of
    the result key."""
    (results.select(*RESULT_COLS, _shard(shards)).repartition(buckets, *RESULT_KEY)
     .write.format("parquet").partitionBy("shard").bucketBy(buckets, *RESULT_KEY).option("path", path).saveAsTable(name))


def merged_shards(spark: SparkSession, name: str, incoming: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``upsert_results`` of the shards that ``incoming`` touches: no other folder of the table is read, and the stored
    side, bucketed by the key, needs no exchange."""
    touched = [r[0] for r in incoming.select(_shard(shards)).distinct().collect()]  # at most ``shards`` numbers
    stored = spark.table(name).where(F.col("shard").isin(touched))
    return upsert_results(stored, incoming).select(*RESULT_COLS, _shard(shards))


def upsert_result_table(spark: SparkSession, name: str, incoming: DataFrame, shards: int = SHARDS) -> None:
    """INSERT ... ON CONFLICT into a table of ``create_result_table``. The touched shards are written beside the table
    and replace the old ones when all are done; the files of the others stay as they are."""
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    merged = merged_shards(spark, name, incoming, shards)
    spark.conf.set(mode, "dynamic")
    try:
        merged.write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def best_result_writeback(questions: DataFrame, best: DataFrame, failure_score: float = FAILURE_SCORE) -> DataFrame:
    """Write the best answer/score onto each question; a question processed
    without any result gets the failure score 1.0."""
    b = best.select(F.col("question_id").alias("id"), "best_answer", "best_score")
    j = questions.join(b, "id", "left")
    return j.select(
        "id",
        F.coalesce(F.col("best_answer"), F.col("llm_answer") if "llm_answer" in questions.columns
                   else F.lit(None).cast("string")).alias("llm_answer"),
        F.coalesce(F.col("best_score"), F.lit(failure_score)).alias("quality_score"),
    )


#: Timestamps of a stored question; absent columns count as NULL.
QUESTION_TIMES = ("created_at", "updated_at", "first_access", "last_access")


def upsert_questions(existing: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """Batch form of the per-record question upsert.

    Records are grouped by the null-safe key (title, content): a matching key
    adds the record count to ``access_count`` on its first stored row (smallest
    id), takes the last non-empty answer and last non-null score, and touches
    ``updated_at`` and ``last_access``; a new key is inserted once with
    ``access_count`` = count and a dense id after the current maximum, in order
    of arrival (first ``seq``). All timestamp columns of stored rows stay.
    """
    key = ["question_title", "question_content"]
    seq = F.struct(F.col("seq"))
    for c in QUESTION_TIMES:
        if c not in existing.columns:
            existing = existing.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    # counts and last values on the 16-byte null-safe pair key: no text in this shuffle but the answers
    records = records.withColumn("_k", pair_key(F.col("question_title"), F.col("question_content")))
    existing_k = existing.select("id", pair_key(F.col("question_title"), F.col("question_content")).alias("_k"))
    inc = records.groupBy("_k").agg(
        F.count(F.lit(1)).alias("n_records"), F.min("seq").alias("first_seq"),
        F.max_by(F.col("llm_answer"), F.when(F.col("llm_answer").isNotNull() & (F.col("llm_answer") != ""), seq))
        .alias("new_answer"),
        F.max_by(F.col("quality_score"), F.when(F.col("quality_score").isNotNull(), seq)).alias("new_score"),
        F.min_by(F.col("original_answer"), seq).alias("new_original"),
    )
    first = existing_k.groupBy("_k").agg(F.min("id").alias("first_id"))
    m = inc.join(first, "_k", "left")

    upd = m.filter(F.col("first_id").isNotNull()).select(
        F.col("first_id").alias("id"), "n_records", "new_answer", "new_score")
    old = existing.join(upd, "id", "left")
    touched = F.col("n_records").isNotNull()
    updated = old.select(
        "id", "question_title", "question_content", "original_answer",
        F.when(touched, conditional_overwrite_text(F.col("new_answer"), F.col("llm_answer")))
        .otherwise(F.col("llm_answer")).alias("llm_answer"),
        F.when(touched, conditional_overwrite_value(F.col("new_score"), F.col("quality_score")))
        .otherwise(F.col("quality_score")).alias("quality_score"),
        (F.col("access_count") + F.coalesce(F.col("n_records"), F.lit(0))).cast("int").alias("access_count"),
        "original_class", "created_at",
        F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
        "first_access",
        F.when(touched, now).otherwise(F.col("last_access")).alias("last_access"),
    )

    # arrival order of the new keys: only (first_seq, key) is ranked, the texts join afterwards
    ins = m.filter(F.col("first_id").isNull())
    ranked = global_dense_id(ins.select("first_seq", "_k"), ["first_seq"], id_col="rank").select("_k", "rank")
    max_id = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id"))
    texts = records.select(F.col("seq").alias("first_seq"), "_k", *key)
    ins = ins.join(ranked, "_k").join(texts, ["_k", "first_seq"]).crossJoin(max_id)  # max_id is one row
    inserted = ins.select(
        (F.col("max_id") + F.col("rank")).alias("id"), *key,
        F.col("new_original").alias("original_answer"),
        F.col("new_answer").alias("llm_answer"), F.col("new_score").alias("quality_score"),
        F.col("n_records").cast("int").alias("access_count"),
        F.lit(None).cast("int").alias("original_class"),
        *[now.alias(c) for c in QUESTION_TIMES],
    )
    return updated.unionByName(inserted)
