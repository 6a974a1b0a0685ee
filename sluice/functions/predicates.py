"""Predicates and conditional projections of the Q&A tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.schemas import HIGH_QUALITY_THRESHOLD


def is_unprocessed(answer: Column) -> Column:
    """``llm_answer IS NULL OR llm_answer = ''`` (model phase filter)."""
    return answer.isNull() | (answer == "")


def is_processed(answer: Column) -> Column:
    """Views count ``llm_answer IS NOT NULL`` as processed: '' is processed here."""
    return answer.isNotNull()


def falsy_default(c: Column, default, kind: str = "number") -> Column:
    """Python ``x or d``: NULL and 0 / '' take the default (not ``coalesce``)."""
    falsy = c.isNull() | ((c == 0) if kind == "number" else (c == ""))
    return F.when(falsy, F.lit(default)).otherwise(c)


def falsy_default_sql(x: str, default: str, kind: str = "number") -> str:
    cmp = f"{x} = 0" if kind == "number" else f"{x} = ''"
    return f"CASE WHEN {x} IS NULL OR {cmp} THEN {default} ELSE {x} END"


def positive_only(c: Column) -> Column:
    """``CASE WHEN c > 0 THEN c END`` inside aggregates."""
    return F.when(c > 0, c)


def high_quality(score: Column, threshold: float = HIGH_QUALITY_THRESHOLD) -> Column:
    return score >= threshold


def null_safe_match(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    """Join condition ``a.c <=> b.c`` for each column (None matches None)."""
    cond = None
    for c in cols:
        e = a[c].eqNullSafe(b[c])
        cond = e if cond is None else cond & e
    return cond


def conditional_overwrite_text(new: Column, old: Column) -> Column:
    """Take the new text only if it is truthy."""
    return F.when(new.isNotNull() & (new != ""), new).otherwise(old)


def conditional_overwrite_value(new: Column, old: Column) -> Column:
    """Take the new value when it is not NULL (0.0 counts)."""
    return F.coalesce(new, old)


# Fixed values (README bands): hit rate > 70 % excellent, quality > 8.0 high,
# latency < 100 ms optimal, memory < 80 % efficient.
RATING_BANDS = {"hit_rate": 70.0, "quality": 8.0, "latency_ms": 100.0, "memory_pct": 80.0}


def rating_band(metric: str, c: Column) -> Column:
    t = RATING_BANDS[metric]
    if metric == "hit_rate":
        return F.when(c > t, F.lit("excellent")).otherwise(F.lit("needs_improvement"))
    if metric == "quality":
        return F.when(c > t, F.lit("high")).otherwise(F.lit("standard"))
    if metric == "latency_ms":
        return F.when(c < t, F.lit("optimal")).otherwise(F.lit("slow"))
    return F.when(c < t, F.lit("efficient")).otherwise(F.lit("high_usage"))


def config_label(policy: Column, size: Column) -> Column:
    """``f"{policy}_size_{size}"``."""
    return F.concat(policy, F.lit("_size_"), size.cast("string"))


def config_parse_policy(label: Column) -> Column:
    return F.split(label, "_size_").getItem(0)


def config_parse_size(label: Column) -> Column:
    return F.try_element_at(F.split(label, "_size_"), F.lit(2)).try_cast("int")


def modulo_content(i: Column, m: int = 100) -> Column:
    """``f"contenido {i % 100}"`` (workload content string)."""
    return F.concat(F.lit("contenido "), F.pmod(i, F.lit(m)).cast("string"))
