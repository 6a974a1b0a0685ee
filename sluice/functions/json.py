"""JSON payload encode / decode and counter updates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.numeric import iso_timestamp

CACHE_PAYLOAD_SCHEMA = T.StructType([
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("llm_answer", T.StringType()),
    T.StructField("original_answer", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("cached_at", T.StringType()),
    T.StructField("policy", T.StringType()),
    T.StructField("access_count", T.LongType()),
    T.StructField("last_accessed", T.StringType()),
])

PROPS_SCHEMA = T.StructType([T.StructField("k", T.LongType())])


def json_encode(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols))


def json_decode(c: Column, schema: T.StructType = CACHE_PAYLOAD_SCHEMA) -> Column:
    return F.from_json(c, schema)


def json_counter_update(payload: Column, now: Column, schema: T.StructType = CACHE_PAYLOAD_SCHEMA) -> Column:
    """``access_count = get(..., 1) + 1`` and ``last_accessed = now``, re-encoded."""
    s = F.from_json(payload, schema)
    s = s.withField("access_count", F.coalesce(s["access_count"], F.lit(1)) + 1)
    s = s.withField("last_accessed", iso_timestamp(now))
    return F.to_json(s)
