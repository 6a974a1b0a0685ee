"""Registered queries: configuration comparison, chart tables, report lines and sinks.

Every query starts from the events log: the 15 (policy, size) metrics are
derived from it (``access_metrics``) and the small comparison steps follow.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.numeric import avg_rounded_sql
from sluice.operators import quantiles as KQ
from sluice.operators import report as R
from sluice.operators.access import SIZED_POLICIES
from sluice.plans.q_access import config_metrics, over_metrics_sql
from sluice.plans.registry import register
from sluice.schemas import CACHE_SIZES, POLICIES
from sluice.session import scratch_path, write_table
from sluice.sources import bindings as B

GRID_SQL = "(VALUES " + ", ".join(
    f"({i * len(CACHE_SIZES) + j}, '{p}', {c})" for i, p in enumerate(POLICIES) for j, c in enumerate(CACHE_SIZES)
) + ") AS grid(ordinal, policy, cache_size)"


@register("policy_size_grid", B.with_ctes(B.EV_CTE) + f"""
SELECT grid.ordinal, grid.policy, grid.cache_size, e.instance, e.ops
FROM {GRID_SQL} CROSS JOIN (SELECT instance, count(*) AS ops FROM ev GROUP BY instance) e""")
def policy_size_grid(spark, sf):
    ops = B.access_log(spark, sf).groupBy("instance").agg(F.count(F.lit(1)).alias("ops"))
    grid = R.policy_size_grid(spark)
    return F.broadcast(grid).crossJoin(ops)  # grid is |policies| x |sizes| rows


@register("config_label", over_metrics_sql("""
SELECT policy || '_size_' || CAST(cache_size AS VARCHAR) AS config, policy, cache_size FROM cm"""))
def config_label(spark, sf):
    return R.config_labels(config_metrics(spark, sf))


@register("best_configs", over_metrics_sql(f"""
, o AS (SELECT cm.*, grid.ordinal, cm.policy || '_size_' || CAST(cm.cache_size AS VARCHAR) AS label
        FROM cm JOIN {GRID_SQL} USING (policy, cache_size))
SELECT (SELECT label FROM o ORDER BY hit_rate_percent DESC, ordinal LIMIT 1) AS best_hit_rate_config,
       (SELECT max(hit_rate_percent) FROM o) AS best_hit_rate,
       (SELECT label FROM o ORDER BY evictions, ordinal LIMIT 1) AS fewest_evictions_config,
       (SELECT min(evictions) FROM o) AS fewest_evictions,
       (SELECT label FROM o ORDER BY cache_efficiency DESC, ordinal LIMIT 1) AS best_efficiency_config,
       (SELECT max(cache_efficiency) FROM o) AS best_efficiency"""))
def best_configs(spark, sf):
    return R.best_configs(config_metrics(spark, sf))


@register("pivot_metric", over_metrics_sql("""
SELECT cache_size, max(CASE WHEN policy = 'LRU' THEN hit_rate_percent END) AS "LRU",
       max(CASE WHEN policy = 'TTL-LRU' THEN hit_rate_percent END) AS "TTL-LRU"
FROM cm GROUP BY cache_size"""))
def pivot_metric(spark, sf):
    return R.pivot_metric(config_metrics(spark, sf), "hit_rate_percent", SIZED_POLICIES)


@register("pivot_evictions", over_metrics_sql("""
SELECT cache_size, CAST(max(CASE WHEN policy = 'LRU' THEN evictions END) AS BIGINT) AS "LRU",
       CAST(max(CASE WHEN policy = 'TTL-LRU' THEN evictions END) AS BIGINT) AS "TTL-LRU"
FROM cm GROUP BY cache_size"""))
def pivot_evictions(spark, sf):
    """The evictions panel."""
    return R.pivot_metric(config_metrics(spark, sf), "evictions", SIZED_POLICIES)


@register("mean_by_group", over_metrics_sql(f"""
SELECT cache_size, policy, {avg_rounded_sql('hit_rate_percent', 2, 4)} AS mean_hit_rate_percent,
       {avg_rounded_sql('avg_hit_time_ms', 2, 4)} AS mean_avg_hit_time_ms
FROM cm GROUP BY cache_size, policy"""))
def mean_by_group(spark, sf):
    return R.mean_by_group(config_metrics(spark, sf), ["hit_rate_percent", "avg_hit_time_ms"], ["cache_size", "policy"])


@register("box_stats", over_metrics_sql("""
, ranked AS (SELECT policy, miss_rate_percent AS v,
                    row_number() OVER (PARTITION BY policy ORDER BY miss_rate_percent) - 1 AS r,
                    count(*) OVER (PARTITION BY policy) AS n FROM cm)
SELECT policy, min(v) AS lo, round(sum(CASE WHEN r = floor((0.25 * (n - 1))) THEN v * (1 - ((0.25 * (n - 1)) - floor((0.25 * (n - 1))))) WHEN r = floor((0.25 * (n - 1))) + 1 THEN v * ((0.25 * (n - 1)) - floor((0.25 * (n - 1)))) ELSE 0 END), 6) AS q1, round(sum(CASE WHEN r = floor((0.5 * (n - 1))) THEN v * (1 - ((0.5 * (n - 1)) - floor((0.5 * (n - 1))))) WHEN r = floor((0.5 * (n - 1))) + 1 THEN v * ((0.5 * (n - 1)) - floor((0.5 * (n - 1)))) ELSE 0 END), 6) AS median, round(sum(CASE WHEN r = floor((0.75 * (n - 1))) THEN v * (1 - ((0.75 * (n - 1)) - floor((0.75 * (n - 1))))) WHEN r = floor((0.75 * (n - 1))) + 1 THEN v * ((0.75 * (n - 1)) - floor((0.75 * (n - 1)))) ELSE 0 END), 6) AS q3, max(v) AS hi
FROM ranked GROUP BY policy"""))
def box_stats(spark, sf):
    return R.box_stats(config_metrics(spark, sf), "miss_rate_percent")


@register("distribution_hist", B.with_ctes(B.EV_CTE) + """
, r AS (SELECT min(op_ms) AS lo, max(op_ms) AS hi FROM ev)
SELECT instance, CAST(least(floor((op_ms - lo) * 10 / (hi - lo)), 9) AS INTEGER) + 1 AS bucket, count(*) AS n
FROM ev, r GROUP BY 1, 2""")
def distribution_hist(spark, sf):
    log = B.access_log(spark, sf)
    span = log.agg(F.min("op_ms").alias("lo"), F.max("op_ms").alias("hi"))  # one row
    return R.distribution_hist(log.crossJoin(span), "op_ms", ["instance"], F.col("lo"), F.col("hi"), 10)


#: Rank error that a sketch's quartiles and ranges keep to, with much to spare (three to four times the usual one).
RANK_ERROR = 0.01


@register("op_time_box", B.with_ctes(B.EV_CTE) + """
SELECT instance, count(*) AS n, min(op_ms) AS lo, max(op_ms) AS hi, true AS quartiles_within FROM ev GROUP BY instance""")
def op_time_box(spark, sf):
    """Range and quartiles of all operation times by instance from one pass; the quartiles' rank error is checked."""
    log = B.access_log(spark, sf)
    found = write_table(KQ.sketches(log, "op_ms", ["instance"]), "sketches")
    boxes = KQ.box(found, ["instance"])
    errors = KQ.rank_errors(log, "op_ms", boxes, ["instance"])
    worst = F.greatest("q1_error", "median_error", "q3_error")
    return boxes.join(errors, "instance").select("instance", "n", "lo", "hi", (worst <= RANK_ERROR).alias("quartiles_within"))


@register("op_time_hist", B.with_ctes(B.EV_CTE) + """
, r AS (SELECT instance, min(op_ms) AS lo, max(op_ms) AS hi FROM ev GROUP BY instance)
SELECT e.instance, CAST(least(floor((e.op_ms - r.lo) * 10 / (r.hi - r.lo)), 9) AS INTEGER) + 1 AS bucket, count(*) AS exact_n, true AS within
FROM ev e JOIN r USING (instance) GROUP BY 1, 2""")
def op_time_hist(spark, sf):
    """The histogram of operation times that the sketches give, held against exact counts."""
    log = B.access_log(spark, sf)
    found = write_table(KQ.sketches(log, "op_ms", ["instance"]), "sketches")
    rough = KQ.histogram(found, ["instance"], 10)
    span = found.select("instance", "lo", "hi", F.col("n").alias("all"))  # a row an instance
    exact = R.distribution_hist(log.join(F.broadcast(span), "instance"), "op_ms", ["instance", "all"], F.col("lo"), F.col("hi"), 10)
    near = F.abs(F.col("e.n") - F.col("h.n")) <= 2 * RANK_ERROR * F.col("all")
    return (exact.alias("e").join(rough.alias("h"), ["instance", "bucket"])
            .select("instance", "bucket", F.col("e.n").alias("exact_n"), near.alias("within")))


CHART_SQL = """
SELECT policy, cache_size, hit_rate_percent, miss_rate_percent, evictions,
       round(CASE WHEN runtime_seconds > 0 THEN total_operations / runtime_seconds ELSE 0.0 END, 6) AS queries_per_sec,
       (avg_hit_time_ms + avg_miss_time_ms) / 2 AS avg_time_ms
FROM cm"""


@register("chart_frame", over_metrics_sql(CHART_SQL))
def chart_frame(spark, sf):
    return R.chart_frame(config_metrics(spark, sf))


@register("scatter_points", over_metrics_sql(f"""
SELECT policy, hit_rate_percent, queries_per_sec, cache_size / 10 AS point_size FROM ({CHART_SQL})"""))
def scatter_points(spark, sf):
    return R.scatter_points(config_metrics(spark, sf))


REPORT_AT = "2024-01-01 00:00:00"  # the report's clock, fixed for comparison

REPORT_SQL = f"""
SELECT grid.ordinal, cm.policy, cm.cache_size, l.line, l.text FROM cm JOIN {GRID_SQL} USING (policy, cache_size),
LATERAL (SELECT * FROM (VALUES
  (0, printf('  Tamaño %d:', cm.cache_size)),
  (1, printf('    Hit Rate: %.2f%%', cm.hit_rate_percent)),
  (2, printf('    Miss Rate: %.2f%%', cm.miss_rate_percent)),
  (3, printf('    Evictions: %d', cm.evictions)),
  (4, printf('    Tiempo promedio hit: %.2fms', cm.avg_hit_time_ms)),
  (5, printf('    Tiempo promedio miss: %.2fms', cm.avg_miss_time_ms)),
  (6, printf('    Eficiencia cache: %.2f%%', cm.cache_efficiency)),
  (7, '')) AS v(line, text)) l"""


@register("report_rows", over_metrics_sql(REPORT_SQL))
def report_rows(spark, sf):
    return R.report_rows(config_metrics(spark, sf))


def _values(lines: list[str]) -> str:
    return " UNION ALL ".join("SELECT '" + x.replace("'", "''") + "' AS text" for x in lines)


FULL_REPORT_SQL = over_metrics_sql(f"""
, o AS (SELECT cm.*, grid.ordinal, cm.policy || '_size_' || CAST(cm.cache_size AS VARCHAR) AS label
        FROM cm JOIN {GRID_SQL} USING (policy, cache_size))
{_values(R.report_header(REPORT_AT))}
UNION ALL SELECT 'POLÍTICA ' || policy || ':' FROM (SELECT DISTINCT policy FROM cm)
UNION ALL SELECT '{R.RULE}' FROM (SELECT DISTINCT policy FROM cm)
UNION ALL SELECT text FROM ({REPORT_SQL})
UNION ALL {_values(R.BEST_HEADER)}
UNION ALL SELECT printf('Mejor Hit Rate: %s (%.2f%%)', label, hit_rate_percent) FROM (SELECT * FROM o ORDER BY hit_rate_percent DESC, ordinal LIMIT 1)
UNION ALL SELECT printf('Menores Evictions: %s (%d evictions)', label, evictions) FROM (SELECT * FROM o ORDER BY evictions, ordinal LIMIT 1)
UNION ALL SELECT printf('Mejor Eficiencia: %s (%.2f%%)', label, cache_efficiency) FROM (SELECT * FROM o ORDER BY cache_efficiency DESC, ordinal LIMIT 1)""")


@register("report_text_sink", FULL_REPORT_SQL)
def report_text_sink(spark, sf):
    """The whole report: header, policies with their sizes, best configurations."""
    path = scratch_path(spark, "report")
    R.write_report_text(config_metrics(spark, sf), path, REPORT_AT)
    return spark.read.text(path).select(F.col("value").alias("text"))


@register("chart_data_export", over_metrics_sql(CHART_SQL))
def chart_data_export(spark, sf):
    path = scratch_path(spark, "charts")
    R.export_chart_data(config_metrics(spark, sf), path)
    return spark.read.parquet(path)


@register("config_parse", over_metrics_sql("""
SELECT policy || '_size_' || CAST(cache_size AS VARCHAR) AS config,
       split_part(policy || '_size_' || CAST(cache_size AS VARCHAR), '_size_', 1) AS parsed_policy,
       TRY_CAST(split_part(policy || '_size_' || CAST(cache_size AS VARCHAR), '_size_', 2) AS INTEGER) AS parsed_size
FROM cm"""))
def config_parse(spark, sf):
    lab = R.config_labels(config_metrics(spark, sf))
    return lab.select("config", F.col("policy").alias("parsed_policy"), F.col("cache_size").alias("parsed_size"))


@register("midpoint_latency", over_metrics_sql("""
SELECT policy, cache_size, (avg_hit_time_ms + avg_miss_time_ms) / 2 AS midpoint_ms FROM cm"""))
def midpoint_latency(spark, sf):
    from sluice.functions.numeric import midpoint_latency as mid

    m = config_metrics(spark, sf)
    return m.select("policy", "cache_size", mid(F.col("avg_hit_time_ms"), F.col("avg_miss_time_ms")).alias("midpoint_ms"))
