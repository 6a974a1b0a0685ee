"""Numeric helpers: guarded ratios, exact HALF_UP rounding, times, formats.

ANSI mode is on in Spark 4, so every division is guarded. Rounded averages
and percentages are computed from integer sums (values are scaled to
integers first), which makes them bit-identical in Spark and DuckDB and
rounds HALF_UP like PostgreSQL ``numeric``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio_pct(n: Column, d: Column) -> Column:
    """``n/d*100 if d>0 else 0`` (unrounded)."""
    return F.when(d > 0, n.cast("double") / d * 100.0).otherwise(F.lit(0.0))


def idiv(a: Column, b: Column) -> Column:
    """Exact integer division (SQL ``div``) in 38-digit decimals: products of counts do not overflow a long."""
    return F.call_function("div", a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))


def round_ratio(num: Column, den: Column, scale: int) -> Column:
    """``round(num/den, scale)`` HALF_UP for non-negative integer columns; 0 when den <= 0."""
    p = 10 ** scale
    n, d = num.cast("decimal(28,0)"), den.cast("decimal(28,0)")
    q = idiv(n * F.lit(2 * p).cast("decimal(10,0)") + d, d * 2)
    return F.when(den > 0, q.cast("double") / p).otherwise(F.lit(0.0))


def round_ratio_sql(num: str, den: str, scale: int) -> str:
    p = 10 ** scale
    return (f"CASE WHEN ({den}) > 0 THEN CAST((CAST({num} AS HUGEINT) * {2 * p} + CAST({den} AS HUGEINT)) "
            f"// (CAST({den} AS HUGEINT) * 2) AS DOUBLE) / {p} ELSE 0.0 END")


def scaled(c: Column, in_scale: int) -> Column:
    """Integer image of a value with at most ``in_scale`` decimals."""
    return F.round(c * (10 ** in_scale)).cast("long")


def scaled_sql(x: str, in_scale: int) -> str:
    return f"CAST(round({x} * {10 ** in_scale}) AS BIGINT)"


def avg_rounded(c: Column, in_scale: int = 2, out_scale: int = 3, where: Column | None = None) -> Column:
    """Aggregate: average of ``c`` (``in_scale`` decimals) rounded HALF_UP; NULL when no rows."""
    v = c if where is None else F.when(where, c)
    s = F.sum(scaled(v, in_scale))
    n = F.count(v)
    p = 10 ** out_scale
    den = n * (10 ** in_scale)
    q = idiv(s * (2 * p) + den, den * 2)
    # negative sums are rounded away from zero (HALF_UP on magnitude)
    qneg = -idiv(-s * (2 * p) + den, den * 2)
    return F.when(n > 0, F.when(s >= 0, q).otherwise(qneg).cast("double") / p)


def avg_rounded_sql(x: str, in_scale: int = 2, out_scale: int = 3, where: str | None = None) -> str:
    v = x if where is None else f"CASE WHEN {where} THEN {x} END"
    s = f"sum({scaled_sql(v, in_scale)})"
    n = f"count({v})"
    p = 10 ** out_scale
    den = f"({n} * {10 ** in_scale})"
    return (f"CASE WHEN {n} > 0 THEN CAST(CASE WHEN {s} >= 0 THEN ({s} * {2 * p} + {den}) // ({den} * 2) "
            f"ELSE -((-{s} * {2 * p} + {den}) // ({den} * 2)) END AS DOUBLE) / {p} END")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000.0


def qps(ops: Column, seconds: Column) -> Column:
    """Operations per second, 0 when the span is empty."""
    return F.when(seconds > 0, ops.cast("double") / seconds).otherwise(F.lit(0.0))


def midpoint_latency(avg_hit: Column, avg_miss: Column) -> Column:
    """Unweighted mean of the hit and miss latencies (chart column)."""
    return (avg_hit + avg_miss) / 2


def iso_timestamp(ts: Column) -> Column:
    """``isoformat()`` with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def iso_timestamp_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"


def report_timestamp(ts: Column) -> Column:
    """``strftime('%Y-%m-%d %H:%M:%S')``."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def format_pct(x: Column) -> Column:
    """``f"{x:.2f}%"``."""
    return F.format_string("%.2f%%", x)


def format_thousands(n: Column) -> Column:
    """``f"{n:,}"`` for integers."""
    return F.format_number(n, 0)
