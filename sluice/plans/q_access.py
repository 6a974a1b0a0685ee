"""Registered queries: access-log analytics (TTL rules, reuse distance, curves, metrics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import scoring as S
from sluice.functions.numeric import round_ratio, round_ratio_sql
from sluice.operators import access as A
from sluice.operators.sequence import previous_in_group
from sluice.plans.registry import register
from sluice.schemas import CACHE_SIZES, DEFAULT_TTL_SECONDS
from sluice.session import write_table
from sluice.sources import bindings as B

TTL_HOURS = [6, 24, 72]
CURVE_SIZES = [10, 50, 100, 500, 1000, 2000]

def seq_ctes(src: str = "ev") -> str:
    """Positions, previous access and reuse distance of an access-log relation, in SQL."""
    return SEQ_CTES.replace("ORDER BY ts, seq) AS pos FROM ev)", f"ORDER BY ts, seq) AS pos FROM {src})")


SEQ_CTES = """
seqd AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY ts, seq) AS pos FROM ev),
seql AS (SELECT *, lag(pos) OVER (PARTITION BY instance, key ORDER BY pos) AS prev_pos,
                   lag(ts) OVER (PARTITION BY instance, key ORDER BY pos) AS prev_ts FROM seqd),
rd AS (
  SELECT a.instance, a.key, a.seq, a.ts, a.op_ms, a.pos, a.prev_pos,
         (SELECT count(DISTINCT b.key) FROM seqd b
          WHERE b.instance = a.instance AND b.pos > a.prev_pos AND b.pos < a.pos) AS reuse_distance
  FROM seql a WHERE a.prev_pos IS NOT NULL
)"""


def anchors_ctes(ttl_seconds: int, name: str = "anchors") -> str:
    """Fixed-TTL anchors in SQL: ASOF next access + recursive chain from the first access."""
    return f"""
{name}_nxt AS (
  SELECT p.instance, p.key, p.seq, arg_min(q.seq, (q.ts, q.seq)) AS j
  FROM ev p JOIN ev q ON p.instance = q.instance AND p.key = q.key
   AND q.ts >= p.ts + INTERVAL {int(ttl_seconds)} SECOND
  GROUP BY p.instance, p.key, p.seq
),
{name} AS (
  SELECT instance, key, seq FROM (
    SELECT instance, key, seq, row_number() OVER (PARTITION BY instance, key ORDER BY ts, seq) AS rn FROM ev
  ) WHERE rn = 1
  UNION ALL
  SELECT n.instance, n.key, n.j FROM {name} a JOIN {name}_nxt n
    ON n.instance = a.instance AND n.key = a.key AND n.seq = a.seq
)"""


def rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(c.strip() for c in ctes) + "\n"


EV = B.with_ctes(B.EV_CTE)


@register("access_count_agg", EV + """
SELECT instance, key, count(*) AS accesses, min(ts) AS first_access, max(ts) AS last_access
FROM ev GROUP BY instance, key""")
def access_count_agg(spark, sf):
    return A.access_count_agg(B.access_log(spark, sf))


def _ttl_values_sql(hours):
    return "(VALUES " + ", ".join(f"({h})" for h in hours) + ") AS t(ttl_hours)"


@register("ttl_hits_sliding", B.with_ctes(B.EV_CTE, SEQ_CTES.split(",\nrd AS")[0]) + f"""
SELECT t.ttl_hours,
       count(CASE WHEN s.prev_ts IS NOT NULL AND epoch_us(s.ts) - epoch_us(s.prev_ts) < t.ttl_hours * 3600000000 THEN 1 END) AS hits,
       count(CASE WHEN NOT (s.prev_ts IS NOT NULL AND epoch_us(s.ts) - epoch_us(s.prev_ts) < t.ttl_hours * 3600000000) THEN 1 END) AS misses
FROM seql s CROSS JOIN {_ttl_values_sql(TTL_HOURS)} GROUP BY t.ttl_hours""")
def ttl_hits_sliding(spark, sf):
    s = previous_in_group(B.access_log(spark, sf).select("instance", "key", "ts", "seq"), ["instance", "key"], ["ts", "seq"], ["ts"])
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))
    aggs = []
    for h in TTL_HOURS:
        hit = F.coalesce(gap < h * 3_600_000_000, F.lit(False))
        aggs += [F.count_if(hit).alias(f"h{h}"), F.count_if(~hit).alias(f"m{h}")]
    one = s.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("ttl_hours"), F.col(f"h{h}").alias("hits"),
                                        F.col(f"m{h}").alias("misses")) for h in TTL_HOURS]))
    return one.select(rows.alias("r")).select("r.*")


def _fixed_sql():
    ctes = [B.EV_CTE] + [anchors_ctes(h * 3600, f"a{h}") for h in TTL_HOURS]
    parts = [f"SELECT {h} AS ttl_hours, (SELECT count(*) FROM ev) - count(*) AS hits, count(*) AS misses FROM a{h}"
             for h in TTL_HOURS]
    return rec(*ctes) + " UNION ALL ".join(parts)


@register("ttl_hits_fixed", _fixed_sql())
def ttl_hits_fixed(spark, sf):
    log = B.access_log(spark, sf)
    total = log.agg(F.count(F.lit(1)).alias("n"))  # one row
    m = A.fixed_ttl_anchors_multi(log, [h * 3600 for h in TTL_HOURS]).groupBy("ttl_seconds").agg(
        F.count(F.lit(1)).alias("misses"))
    return m.crossJoin(total).select((F.col("ttl_seconds") / 3600).cast("int").alias("ttl_hours"),
                                     (F.col("n") - F.col("misses")).alias("hits"), "misses")


@register("reuse_distance", B.with_ctes(B.EV_CTE, SEQ_CTES) + """
SELECT instance, key, seq, reuse_distance FROM rd""")
def reuse_distance(spark, sf):
    s = A.sequence_log(B.access_log(spark, sf))
    return A.reuse_distance(s).select("instance", "key", "seq", "reuse_distance")


def _curve_sql(sizes):
    return B.with_ctes(B.EV_CTE, SEQ_CTES) + f"""
SELECT c.cache_size, (SELECT count(*) FROM ev) AS accesses,
       count(rd.seq) AS hits,
       {round_ratio_sql('count(rd.seq) * 100', '(SELECT count(*) FROM ev)', 2)} AS hit_rate_percent
FROM (VALUES {', '.join(f'({s})' for s in sizes)}) AS c(cache_size)
LEFT JOIN rd ON rd.reuse_distance < c.cache_size
GROUP BY c.cache_size"""


@register("hit_rate_curve", _curve_sql(CURVE_SIZES))
def hit_rate_curve(spark, sf):
    s = A.sequence_log(B.access_log(spark, sf))
    return A.hit_rate_curve(s, A.reuse_distance(s), CURVE_SIZES)


@register("hit_rate_curve_orders", _curve_sql(CURVE_SIZES).replace(B.EV_CTE.strip(), B.ORDERS_CTE.strip()))
def hit_rate_curve_orders(spark, sf):
    """The curve of a log with more keys than the middle sizes."""
    s = A.sequence_log(B.orders_log(spark, sf))
    return A.hit_rate_curve(s, A.reuse_distance(s), CURVE_SIZES)


SAMPLE_KEYS = 40


def _sampled_ctes() -> str:
    """Keys below the threshold of their instance, and the corrected hits by size."""
    return B.with_ctes(B.EV_CTE) + f"""
, hashed AS (SELECT *, {S.hash60_sql('CAST(key AS VARCHAR)')} AS h FROM ev)
, ordered AS (SELECT instance, h, row_number() OVER (PARTITION BY instance ORDER BY h) AS r FROM (SELECT DISTINCT instance, h FROM hashed))
, limits AS (SELECT instance, coalesce(max(CASE WHEN r = {SAMPLE_KEYS + 1} THEN h END), {S.SPACE}) AS threshold FROM ordered GROUP BY instance)
, evs AS (SELECT e.* EXCLUDE (h) FROM hashed e JOIN limits l USING (instance) WHERE e.h < l.threshold),
""" + seq_ctes("evs") + f"""
, scaled AS (SELECT rd.instance, CAST((CAST(rd.reuse_distance AS HUGEINT) * {S.SPACE}) // l.threshold AS BIGINT) AS d FROM rd JOIN limits l USING (instance))
, kept AS (SELECT instance, count(*) AS n FROM evs GROUP BY instance)
, hit AS (SELECT c.cache_size, s.instance, count(*) AS hits FROM (VALUES {', '.join(f'({s})' for s in CURVE_SIZES)}) AS c(cache_size)
          JOIN scaled s ON s.d < c.cache_size GROUP BY c.cache_size, s.instance)
, per AS (
  SELECT c.cache_size, a.n AS accesses, k.n AS sampled,
         greatest(0, a.n - CAST((CAST(k.n - coalesce(hit.hits, 0) AS HUGEINT) * {S.SPACE}) // l.threshold AS BIGINT)) AS hits
  FROM (VALUES {', '.join(f'({s})' for s in CURVE_SIZES)}) AS c(cache_size)
  CROSS JOIN (SELECT instance, count(*) AS n FROM ev GROUP BY instance) a JOIN kept k USING (instance) JOIN limits l USING (instance)
  LEFT JOIN hit ON hit.cache_size = c.cache_size AND hit.instance = a.instance)
, sampled AS (
  SELECT cache_size, CAST(sum(accesses) AS BIGINT) AS accesses, CAST(sum(sampled) AS BIGINT) AS sampled_accesses, CAST(sum(hits) AS BIGINT) AS hits,
         {round_ratio_sql('sum(hits) * 100', 'sum(accesses)', 2)} AS hit_rate_percent FROM per GROUP BY cache_size)"""


@register("hit_rate_curve_sampled", _sampled_ctes() + "\nSELECT * FROM sampled")
def hit_rate_curve_sampled(spark, sf):
    """The curve from a bounded number of keys: far fewer than the log has, so that the threshold falls."""
    return A.hit_rate_curve_sampled(B.access_log(spark, sf), CURVE_SIZES, SAMPLE_KEYS)


@register("hit_rate_curve_error", _sampled_ctes() + f"""
, exact AS ({_curve_sql(CURVE_SIZES)})
SELECT s.cache_size, s.sampled_accesses, s.hit_rate_percent AS sampled_percent, e.hit_rate_percent AS exact_percent,
       round(abs(s.hit_rate_percent - e.hit_rate_percent), 2) AS error_points
FROM sampled s JOIN exact e USING (cache_size)""")
def hit_rate_curve_error(spark, sf):
    """How far the sampled curve is from the exact one."""
    log = B.access_log(spark, sf)
    s = A.sequence_log(log)
    return A.curve_error(A.hit_rate_curve_sampled(log, CURVE_SIZES, SAMPLE_KEYS), A.hit_rate_curve(s, A.reuse_distance(s), CURVE_SIZES))


RATES_SQL = f"""
SELECT policy, CAST(cache_size AS INTEGER) AS cache_size, CAST(ttl_hours AS INTEGER) AS ttl_hours,
       CAST(ops AS BIGINT) AS total_operations, CAST(hits AS BIGINT) AS hits, CAST(misses AS BIGINT) AS misses,
       CAST(misses AS BIGINT) AS sets, CAST(evictions AS BIGINT) AS evictions,
       {round_ratio_sql('hits * 100', 'ops', 2)} AS hit_rate_percent,
       {round_ratio_sql('misses * 100', 'ops', 2)} AS miss_rate_percent,
       CASE WHEN evictions IS NOT NULL THEN {round_ratio_sql('evictions * 100', 'ops', 2)} END AS eviction_rate_percent,
       {round_ratio_sql('coalesce(hit_ms, 0)', 'hits * 100', 2)} AS avg_hit_time_ms,
       {round_ratio_sql('coalesce(miss_ms, 0)', 'misses * 100', 2)} AS avg_miss_time_ms,
       {round_ratio_sql('hits * 100', 'hits + misses', 2)} AS cache_efficiency,
       CASE WHEN evictions IS NOT NULL THEN {round_ratio_sql('hits * 100', 'hits + misses + evictions', 2)} END AS efficiency_evict,
       coalesce((epoch_us(t1) - epoch_us(t0)) / 1e6, 0.0) AS runtime_seconds
FROM """


def sized_sql(ttl_seconds: int = DEFAULT_TTL_SECONDS) -> str:
    """The metrics of the sized policies: one branch per configuration, each with its own literal policy.

    Evictions by definition: entries with as many distinct other keys as the size accessed after them, before their
    key comes again and, with a TTL, before they expire."""
    us = int(ttl_seconds) * 1_000_000
    hit = "(reuse_distance IS NOT NULL AND reuse_distance < {c})"
    rules = {"LRU": hit, "TTL-LRU": "(" + hit + " AND sliding_hit)"}
    pushed = {"LRU": "until_next", "TTL-LRU": "until_expiry"}
    branches = [f"""
  SELECT concat('{p}', '') AS policy, {c} AS cache_size, instance, count(*) AS ops,
         count(CASE WHEN {rules[p].format(c=c)} THEN 1 END) AS hits,
         count(CASE WHEN {pushed[p]} >= {c} THEN 1 END) AS evictions,
         sum(CASE WHEN {rules[p].format(c=c)} THEN ms END) AS hit_ms,
         sum(CASE WHEN NOT {rules[p].format(c=c)} THEN ms END) AS miss_ms, min(ts) AS t0, max(ts) AS t1
  FROM flags GROUP BY instance""" for p in A.SIZED_POLICIES for c in CACHE_SIZES]
    return B.with_ctes(B.EV_CTE, SEQ_CTES) + f"""
, seqn AS (SELECT *, lead(pos) OVER (PARTITION BY instance, key ORDER BY pos) AS next_pos FROM seqd)
, later AS (
  SELECT a.instance, a.pos, count(DISTINCT b.key) AS until_next,
         count(DISTINCT CASE WHEN epoch_us(b.ts) - epoch_us(a.ts) < {us} THEN b.key END) AS until_expiry
  FROM seqn a JOIN seqd b ON b.instance = a.instance AND b.pos > a.pos AND (a.next_pos IS NULL OR b.pos < a.next_pos)
  GROUP BY a.instance, a.pos)
, flags AS (
  SELECT s.instance, s.ts, CAST(round(s.op_ms * 100) AS BIGINT) AS ms, rd.reuse_distance,
         coalesce(epoch_us(s.ts) - epoch_us(s.prev_ts) < {us}, false) AS sliding_hit,
         coalesce(later.until_next, 0) AS until_next, coalesce(later.until_expiry, 0) AS until_expiry
  FROM seql s LEFT JOIN rd ON rd.instance = s.instance AND rd.pos = s.pos
  LEFT JOIN later ON later.instance = s.instance AND later.pos = s.pos
), per AS ({' UNION ALL '.join(branches)}
), sized AS (
  SELECT policy, cache_size, CAST(NULL AS INTEGER) AS ttl_hours, sum(ops) AS ops, sum(hits) AS hits, sum(ops - hits) AS misses,
         sum(evictions) AS evictions, sum(hit_ms) AS hit_ms, sum(miss_ms) AS miss_ms, min(t0) AS t0, max(t1) AS t1
  FROM per GROUP BY policy, cache_size
)"""


def over_metrics_sql(query: str, ttl_seconds: int = DEFAULT_TTL_SECONDS) -> str:
    """SQL that reads the metrics of the sized configurations as the CTE ``cm``."""
    return sized_sql(ttl_seconds) + ",\ncm AS (" + RATES_SQL + "sized)\n" + query


def _ttl_sql() -> str:
    branches = [f"SELECT {h} AS ttl_hours, count(*) AS misses, sum(ms) AS miss_ms FROM (SELECT CAST(round(ev.op_ms * 100) AS BIGINT) AS ms "
                f"FROM a{h} JOIN ev USING (instance, key, seq))" for h in TTL_HOURS]
    return rec(B.EV_CTE, *[anchors_ctes(h * 3600, f"a{h}") for h in TTL_HOURS]) + f"""
, missed AS ({' UNION ALL '.join(branches)}),
total AS (SELECT count(*) AS ops, sum(CAST(round(op_ms * 100) AS BIGINT)) AS all_ms, min(ts) AS t0, max(ts) AS t1 FROM ev),
byttl AS (SELECT concat('TTL', '') AS policy, CAST(NULL AS INTEGER) AS cache_size, ttl_hours, ops, ops - misses AS hits, misses,
                 CAST(NULL AS BIGINT) AS evictions, all_ms - miss_ms AS hit_ms, miss_ms, t0, t1 FROM missed, total)
""" + RATES_SQL + "byttl"


def config_metrics(spark, sf):
    """The metrics of the sized configurations (LRU and TTL-LRU by size) of the events log."""
    # ten rows that reports read several times
    return write_table(A.access_metrics(A.access_flags(B.access_log(spark, sf), DEFAULT_TTL_SECONDS), A.SIZED_POLICIES, CACHE_SIZES), "metrics")


@register("access_metrics", over_metrics_sql("SELECT * FROM cm"))
def access_metrics(spark, sf):
    return config_metrics(spark, sf)


@register("ttl_metrics", _ttl_sql())
def ttl_metrics(spark, sf):
    """The policy TTL by TTL: expiry counted from the set, no capacity."""
    return A.ttl_metrics(B.access_log(spark, sf), TTL_HOURS)


LOOKUP_SQL = EV + """
, snap AS (SELECT DISTINCT instance, key FROM ev WHERE ts < (SELECT min(ts) FROM ev) + INTERVAL 7 DAY)
SELECT e.instance, count(*) AS lookups, count(s.key) AS hits, count(*) - count(s.key) AS misses
FROM ev e LEFT JOIN snap s ON s.instance = e.instance AND s.key = e.key
WHERE e.ts >= (SELECT min(ts) FROM ev) + INTERVAL 7 DAY
GROUP BY e.instance"""


@register("lookup_hit", LOOKUP_SQL)
def lookup_hit(spark, sf):
    log = B.access_log(spark, sf)
    cut = log.agg((F.min("ts") + F.expr("INTERVAL 7 DAYS")).alias("cut"))  # one row
    j = A.lookup_hit(log.crossJoin(cut), F.col("cut"))
    return j.groupBy("instance").agg(F.count(F.lit(1)).alias("lookups"), F.count_if("hit").alias("hits"),
                                     F.count_if(~F.col("hit")).alias("misses"))


@register("throughput", EV + """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS requests,
       count(*) / 86400.0 AS requests_per_second
FROM ev GROUP BY 1""")
def throughput(spark, sf):
    return A.throughput(B.access_log(spark, sf), "1 day")


@register("error_rate", EV + f"""
SELECT CAST(ts AS DATE) AS day, count(*) AS requests, count(CASE WHEN is_error THEN 1 END) AS errors,
       {round_ratio_sql('count(CASE WHEN is_error THEN 1 END) * 100', 'count(*)', 2)} AS error_rate_percent
FROM ev GROUP BY 1""")
def error_rate(spark, sf):
    log = B.access_log(spark, sf).withColumn("day", F.to_date("ts"))
    return A.error_rate(log, ["day"])


@register("qps_by_instance", EV + f"""
SELECT instance, count(*) AS requests,
       {round_ratio_sql('count(*) * 1000000', 'max(epoch_us(ts)) - min(epoch_us(ts))', 6)} AS qps_micro
FROM ev GROUP BY instance""")
def qps_by_instance(spark, sf):
    log = B.access_log(spark, sf).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    g = log.groupBy("instance").agg(F.count(F.lit(1)).alias("requests"), F.min("us").alias("a"), F.max("us").alias("b"))
    return g.select("instance", "requests",
                    round_ratio(F.col("requests") * 1000000, F.col("b") - F.col("a"), 6).alias("qps_micro"))
