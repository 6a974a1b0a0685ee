"""Deterministic hash scores.

The reference scores with Python's per-process seeded ``hash``; we fix the
hash to the first 32 bits of md5 so scores are reproducible in Spark and in
the DuckDB oracle. Scores are computed in integers (scaled by 1e5) and rounded
HALF_UP to 2 decimals, so both engines produce the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1000


def score_input(title: Column, content: Column) -> Column:
    """Text that is scored: ``title + "\\n" + (content or '')``."""
    return F.concat(title, F.lit("\n"), F.coalesce(content, F.lit("")))


def hash32(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def hash32_sql(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"


#: Values of ``hash60``.
SPACE = 1 << 60


def hash60(x: Column) -> Column:
    """The first 60 bits of md5 as a number."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def hash60_sql(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 15)) AS BIGINT)"


def hash_bucket(x: Column, buckets: int = BUCKETS) -> Column:
    """Stable bucket 0..buckets-1 of a string."""
    return F.pmod(hash32(x), F.lit(buckets))


def hash_bucket_sql(x: str, buckets: int = BUCKETS) -> str:
    return f"({hash32_sql(x)} % {buckets})"


def hash_score(text: Column, model: Column, lo: Column, hi: Column) -> Column:
    """``round(lo + (h % 1000)/1000 * (hi - lo), 2)`` with h = hash(text + model).

    ``lo``/``hi`` are decimal strings or numbers with at most 2 decimals.
    """
    h = hash_bucket(F.concat(text, model))
    lo_e5 = F.round(lo.cast("decimal(12,5)") * 100000).cast("long")
    span_e2 = F.round((hi.cast("decimal(12,5)") - lo.cast("decimal(12,5)")) * 100).cast("long")
    score_e5 = lo_e5 + h * span_e2
    return F.call_function("div", score_e5 + 500, F.lit(1000)).cast("double") / 100.0


def hash_score_sql(text: str, model: str, lo: str, hi: str) -> str:
    h = hash_bucket_sql(f"{text} || {model}")
    return (f"CAST((CAST(round({lo} * 100000) AS BIGINT) + {h} * CAST(round(({hi} - {lo}) * 100) AS BIGINT) + 500)"
            f" // 1000 AS DOUBLE) / 100")
