"""Registered queries: streaming runs (availableNow) over the events log.

Each query runs its stream to completion into parquet batch folders and
returns the result read back as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.plans.q_access import SEQ_CTES, anchors_ctes, rec
from sluice.plans.q_scoring import UPSERT_RESULTS_SQL
from sluice.plans.registry import register
from sluice.sources import bindings as B
from sluice.streaming import streams as ST

RESIDENCY_TTL = 6 * 3600
FIXED_TTL = 6 * 3600


@register("stream_residency", B.with_ctes(B.EV_CTE) + f"""
, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL
                         OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {RESIDENCY_TTL * 1_000_000}
                       THEN 1 ELSE 0 END AS new_session
        FROM ev WINDOW w AS (PARTITION BY instance, key ORDER BY ts, seq))
, s AS (SELECT *, sum(new_session) OVER (PARTITION BY instance, key ORDER BY ts, seq) AS sid FROM g)
, sess AS (SELECT instance, key, min(ts) AS session_start,
                  max(ts) + INTERVAL ({RESIDENCY_TTL * 1_000_000 - 1}) MICROSECOND AS session_end,
                  count(*) AS accesses
           FROM s GROUP BY instance, key, sid)
SELECT instance, key, session_start, session_end, accesses, accesses - 1 AS hits, 1 AS misses
FROM sess""")
def stream_residency(spark, sf):
    """All sessions, open ones included, from a log that arrives in parts."""
    stream, arrive = split_stream(spark, sf)
    out = ST.scratch(spark, "residency")
    with ST.keyed_state(spark):
        ST.run_in_parts(ST.residency_sessions(stream, RESIDENCY_TTL), out, arrive, "update")
    return ST.latest_sessions(spark.read.option("basePath", out).parquet(f"{out}/batch_id=*"), RESIDENCY_TTL).drop("closed")


SPLITS = 4


def split_stream(spark, sf):
    """The events as a log that arrives in ``SPLITS`` parts of rising time: the stream, and the steps that let one
    part after the other arrive in its folder."""
    ev = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    span = ev.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))  # one row
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = F.least(F.floor((us("ts") - us("lo")) * SPLITS / (us("hi") - us("lo") + 1)), F.lit(SPLITS - 1)).cast("int")
    held, src = ST.scratch(spark, "held"), ST.scratch(spark, "arrived")
    ev.crossJoin(span).withColumn("part", part).drop("lo", "hi").write.partitionBy("part").parquet(held)
    stream = spark.readStream.schema(ev.schema).parquet(src + "/part=*")
    log = stream.select(
        F.col("event_type").alias("instance"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), F.col("value").alias("op_ms"), (F.col("event_type") == "error").alias("is_error"))
    return log, [lambda i=i: ST.move_path(spark, f"{held}/part={i}", f"{src}/part={i}") for i in range(SPLITS)]


def _flags(spark, sf, name):
    """Fixed-TTL flags of a log that arrives in parts, from keyed state."""
    stream, arrive = split_stream(spark, sf)
    out = ST.scratch(spark, name)
    with ST.keyed_state(spark):
        ST.run_in_parts(ST.fixed_ttl_flags(stream, FIXED_TTL), out, arrive)
    return spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")


FLAGS_SQL = rec(B.EV_CTE, anchors_ctes(FIXED_TTL, "fa")) + """
, fl AS (SELECT e.*, fa.seq IS NULL AS hit
  FROM ev e LEFT JOIN fa ON fa.instance = e.instance AND fa.key = e.key AND fa.seq = e.seq)
"""


@register("stream_first_seen", FLAGS_SQL + "SELECT instance, key, seq, ts FROM fl WHERE NOT hit")
def stream_first_seen(spark, sf):
    """The misses of the TTL rule as they arrive."""
    seen = ST.first_seen(_flags(spark, sf, "first-seen"))
    return seen.select("instance", "key", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register("stream_fixed_ttl", FLAGS_SQL + "SELECT instance, key, seq, hit FROM fl")
def stream_fixed_ttl(spark, sf):
    """Keyed state with timers over several micro-batches and restarts."""
    return _flags(spark, sf, "fixed-ttl").select("instance", "key", "seq", "hit")


@register("stream_fixed_ttl_batched", FLAGS_SQL + "SELECT instance, key, seq, hit FROM fl")
def stream_fixed_ttl_batched(spark, sf):
    """Each micro-batch as range slices, with the state in tables of changes."""
    stream, arrive = split_stream(spark, sf)
    flags = ST.fixed_ttl_by_batch(stream, FIXED_TTL, ST.scratch(spark, "fixed-ttl-batched"), arrive)
    return spark.read.parquet(flags).select("instance", "key", "seq", "hit")


@register("stream_access_counts", B.with_ctes(B.EV_CTE) + """
SELECT instance, key, count(*) AS accesses, max(ts) AS last_access FROM ev GROUP BY instance, key""")
def stream_access_counts(spark, sf):
    out = ST.scratch(spark, "counts")
    ST.run_to_parquet(ST.access_counts(ST.access_stream(spark, sf)), out, "update")
    upd = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")
    latest = ST.latest_counts(upd)
    return latest.select("instance", "key", "accesses", F.col("last_access").cast("timestamp_ntz").alias("last_access"))


@register("stream_hit_metrics", FLAGS_SQL + """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
       count(*) AS ops, count(CASE WHEN hit THEN 1 END) AS hits, count(CASE WHEN NOT hit THEN 1 END) AS misses,
       count(CASE WHEN is_error THEN 1 END) AS errors,
       CAST(sum(CASE WHEN hit THEN CAST(round(op_ms * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS hit_ms_e2,
       CAST(sum(CASE WHEN hit THEN 0 ELSE CAST(round(op_ms * 100) AS BIGINT) END) AS BIGINT) AS miss_ms_e2
FROM fl GROUP BY 1, 2""")
def stream_hit_metrics(spark, sf):
    """Hits and misses per day: every micro-batch of flags is counted, and the counts of its windows are added up."""
    stream, arrive = split_stream(spark, sf)
    out = ST.scratch(spark, "window")
    with ST.keyed_state(spark):
        ST.run_in_parts(ST.fixed_ttl_flags(stream, FIXED_TTL), out, arrive, "append", lambda b: ST.window_metrics(b, "1 day"))
    df = ST.added_windows(spark.read.option("basePath", out).parquet(f"{out}/batch_id=*"))
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@register("stream_upsert_results", B.with_ctes(B.QA_CTE, B.MR_CTE, B.INCOMING_CTE) + "," + UPSERT_RESULTS_SQL
          + " SELECT * FROM merged")
def stream_upsert_results(spark, sf):
    # incoming results arrive as files; each file is one micro-batch
    src = ST.scratch(spark, "incoming")
    B.incoming_results(spark, sf).repartition(3, "question_id").write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = ST.scratch(spark, "upsert")
    final = ST.upsert_sink(stream, B.model_results(spark, sf), out)
    return spark.read.parquet(*final)
