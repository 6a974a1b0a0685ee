"""Configuration comparison, chart tables and the text report.

All inputs here are the small per-configuration metrics frame (one row per
policy x size), so these are cheap single-partition-sized steps; the heavy
work happened in ``access.access_metrics``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.numeric import avg_rounded, qps
from sluice.functions.predicates import config_label, config_parse_policy, config_parse_size
from sluice.schemas import CACHE_SIZES, POLICIES

# ---------------------------------------------------------------------------
# Fixed values (report text of the reference, Spanish):
REPORT_LINES = [
    ("Hit Rate", "    Hit Rate: %.2f%%", "hit_rate_percent"),
    ("Miss Rate", "    Miss Rate: %.2f%%", "miss_rate_percent"),
    ("Evictions", "    Evictions: %d", "evictions"),
    ("Hit time", "    Tiempo promedio hit: %.2fms", "avg_hit_time_ms"),
    ("Miss time", "    Tiempo promedio miss: %.2fms", "avg_miss_time_ms"),
    ("Efficiency", "    Eficiencia cache: %.2f%%", "cache_efficiency"),
]
BEST_LINES = ["Mejor Hit Rate: %s (%.2f%%)", "Menores Evictions: %s (%d evictions)", "Mejor Eficiencia: %s (%.2f%%)"]
# ---------------------------------------------------------------------------


def policy_size_grid(spark, policies: Sequence[str] = POLICIES, sizes: Sequence[int] = CACHE_SIZES) -> DataFrame:
    """Configuration grid with its insertion ordinal (policy-major)."""
    rows = [(i * len(sizes) + j, p, int(c)) for i, p in enumerate(policies) for j, c in enumerate(sizes)]
    return spark.createDataFrame(rows, "ordinal int, policy string, cache_size int")


def with_ordinal(metrics: DataFrame, policies: Sequence[str] = POLICIES, sizes: Sequence[int] = CACHE_SIZES):
    grid = policy_size_grid(metrics.sparkSession, policies, sizes)
    return metrics.join(F.broadcast(grid), ["policy", "cache_size"], "left")  # grid: |policies| x |sizes| rows


def best_configs(metrics: DataFrame) -> DataFrame:
    """argmax hit rate, argmin evictions, argmax efficiency; ties -> first configuration in grid order."""
    m = with_ordinal(metrics).withColumn("label", config_label(F.col("policy"), F.col("cache_size")))
    neg = -F.col("ordinal")
    return m.agg(
        F.max_by("label", F.struct("hit_rate_percent", neg)).alias("best_hit_rate_config"),
        F.max("hit_rate_percent").alias("best_hit_rate"),
        F.max_by("label", F.struct(-F.col("evictions"), neg)).alias("fewest_evictions_config"),
        F.min("evictions").alias("fewest_evictions"),
        F.max_by("label", F.struct("cache_efficiency", neg)).alias("best_efficiency_config"),
        F.max("cache_efficiency").alias("best_efficiency"),
    )


def pivot_metric(metrics: DataFrame, metric: str, policies: Sequence[str] = POLICIES) -> DataFrame:
    """size x policy matrix of one metric (heat-map panel)."""
    return metrics.groupBy("cache_size").pivot("policy", list(policies)).agg(F.first(metric))


def mean_by_group(metrics: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean of two-decimal metrics per group, to four decimals (bar and line panels)."""
    return metrics.groupBy(*by).agg(*[avg_rounded(F.col(c), 2, 4).alias(f"mean_{c}") for c in columns])


def box_stats(metrics: DataFrame, metric: str = "miss_rate_percent") -> DataFrame:
    """Quartiles per policy (box panel); exact percentile over the few configs."""
    q = F.percentile(F.col(metric), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = metrics.groupBy("policy").agg(q.alias("q"), F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    return g.select("policy", "lo", F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[1], 6).alias("median"),
                    F.round(F.col("q")[2], 6).alias("q3"), "hi")


def distribution_hist(df: DataFrame, value: str, by: Sequence[str], lo: Column, hi: Column, buckets: int) -> DataFrame:
    """Histogram (violin panel): equal-width buckets 1..n over the values' own range [lo, hi]; the last
    bucket holds hi, and all values if they are equal."""
    b = F.when(hi > lo, F.least(F.floor((F.col(value) - lo) * buckets / (hi - lo)), F.lit(buckets - 1)).cast("int") + 1).otherwise(F.lit(buckets))
    return df.groupBy(*by, b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def chart_frame(metrics: DataFrame) -> DataFrame:
    """The 7-column frame behind the dashboard panels."""
    return metrics.select(
        "policy", "cache_size", "hit_rate_percent", "miss_rate_percent", "evictions",
        F.round(qps(F.col("total_operations"), F.col("runtime_seconds")), 6).alias("queries_per_sec"),
        ((F.col("avg_hit_time_ms") + F.col("avg_miss_time_ms")) / 2).alias("avg_time_ms"),
    )


def scatter_points(metrics: DataFrame) -> DataFrame:
    """Hit rate vs throughput, cache size / 10 as the point weight."""
    c = chart_frame(metrics)
    return c.select("policy", "hit_rate_percent", "queries_per_sec", (F.col("cache_size") / 10).alias("point_size"))


def config_labels(metrics: DataFrame) -> DataFrame:
    """``{policy}_size_{n}`` labels and their parse back to (policy, size)."""
    lab = config_label(F.col("policy"), F.col("cache_size"))
    m = metrics.select(lab.alias("config"))
    return m.select("config", config_parse_policy(F.col("config")).alias("policy"),
                    config_parse_size(F.col("config")).alias("cache_size"))


def report_rows(metrics: DataFrame) -> DataFrame:
    """Report lines per configuration, ordered by (policy, size, line)."""
    m = with_ordinal(metrics)
    lines = [F.struct(F.lit(0).alias("line"), F.format_string("  Tamaño %d:", F.col("cache_size")).alias("text"))]
    for i, (_n, fmt, col) in enumerate(REPORT_LINES, start=1):
        lines.append(F.struct(F.lit(i).alias("line"), F.format_string(fmt, F.col(col)).alias("text")))
    lines.append(F.struct(F.lit(len(REPORT_LINES) + 1).alias("line"), F.lit("").alias("text")))
    out = m.select("ordinal", "policy", "cache_size", F.explode(F.array(*lines)).alias("l"))
    return out.select("ordinal", "policy", "cache_size", "l.line", "l.text").orderBy("ordinal", "line")


def best_lines(metrics: DataFrame) -> DataFrame:
    b = best_configs(metrics)
    return b.select(F.explode(F.array(
        F.struct(F.lit(1).alias("line"), F.format_string(BEST_LINES[0], "best_hit_rate_config", "best_hit_rate").alias("text")),
        F.struct(F.lit(2).alias("line"), F.format_string(BEST_LINES[1], "fewest_evictions_config", "fewest_evictions").alias("text")),
        F.struct(F.lit(3).alias("line"), F.format_string(BEST_LINES[2], "best_efficiency_config", "best_efficiency").alias("text")),
    )).alias("l")).select("l.line", "l.text")


#: Rule and headings of the report.
RULE = "-" * 40
BEST_HEADER = ["MEJORES CONFIGURACIONES:", RULE]


def report_header(at: str) -> list[str]:
    return ["ANÁLISIS DE RENDIMIENTO DEL CACHE", f"Fecha: {at}", "=" * 40, ""]


def report_lines(metrics: DataFrame, at: str) -> DataFrame:
    """The whole report in order (part, ordinal, line, text): header, a heading per policy, the lines of each
    size, and the best configurations."""
    spark = metrics.sparkSession
    fixed = [(0, 0, i, t) for i, t in enumerate(report_header(at))] + [(2, 0, i - len(BEST_HEADER), t) for i, t in enumerate(BEST_HEADER)]
    head = spark.createDataFrame(fixed, "part int, ordinal int, line int, text string")
    rows = report_rows(metrics)
    policies = rows.groupBy("policy").agg(F.min("ordinal").alias("ordinal")).select(
        F.lit(1).alias("part"), "ordinal", F.explode(F.array(
            F.struct(F.lit(-2).alias("line"), F.concat(F.lit("POLÍTICA "), F.col("policy"), F.lit(":")).alias("text")),
            F.struct(F.lit(-1).alias("line"), F.lit(RULE).alias("text")))).alias("l")).select("part", "ordinal", "l.line", "l.text")
    body = rows.select(F.lit(1).alias("part"), "ordinal", "line", "text")
    best = best_lines(metrics).select(F.lit(2).alias("part"), F.lit(0).alias("ordinal"), "line", "text")
    return head.unionByName(policies).unionByName(body).unionByName(best)


def write_report_text(metrics: DataFrame, path: str, at: str) -> None:
    """``report_text_sink``: the report (a line per policy, size and metric: bounded) as one UTF-8 text file."""
    report_lines(metrics, at).coalesce(1).sortWithinPartitions("part", "ordinal", "line").select("text").write.mode("overwrite").text(path)


def export_chart_data(metrics: DataFrame, path: str) -> None:
    """``chart_data_export``: the dashboard's data (PNG drawing not built)."""
    chart_frame(metrics).coalesce(1).write.mode("overwrite").parquet(path)
