"""Registry of named queries and their DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> str``.
Names are the operator names of the design survey. Operators are added to the
registry by the ``plans.*`` modules at import time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def ensure_utc(spark: SparkSession) -> None:
    """The library computes in UTC (timestamps are wall-clock TIMESTAMP_NTZ; casts
    to TIMESTAMP and day windows must not move with a local session zone)."""
    if spark.conf.get("spark.sql.session.timeZone", None) not in ("UTC", "Etc/UTC", "+00:00", "Z"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name`` with optional oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from sluice.session import ship_package

            ensure_utc(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so that all queries are registered."""
    from sluice.plans import (  # noqa: F401
        q_access,
        q_ingest,
        q_merge,
        q_report,
        q_scalar,
        q_scoring,
        q_streaming,
        q_summaries,
    )
