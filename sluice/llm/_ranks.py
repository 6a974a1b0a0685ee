"""Running totals inside groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets that a group is spread over; per-bucket totals are at most this many rows a group.
BUCKETS = 4096


def running_total(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str,
                  ties: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Add ``out``: the total of ``value`` over the rows of the same ``group`` before this row and this
    row itself. Rows are ordered by a hash bucket of ``order``, then by ``order``, then by ``ties``, which
    need not be the same in another run.

    The totals of the buckets come first (partial sums before the shuffle), their prefix sums give each
    bucket its start, and a window runs inside one bucket: a group holding a third of all rows is spread
    over ``buckets`` windows. ``group`` columns must not be null. ``rows`` is read twice, so give a
    stored table or a cheap plan.
    """
    group = list(group)
    keyed = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(17), *[F.col(c) for c in order]), F.lit(buckets)).cast("int"))
    keyed = keyed.withColumn("_value", value.cast("long"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (keyed.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_total"))
              .select(*group, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")))
    inside = (Window.partitionBy(*group, "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in [*order, *ties]])
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (keyed.join(starts, [*group, "_bucket"])
            .withColumn(out, F.col("_start") + F.sum("_value").over(inside))
            .drop("_bucket", "_value", "_start"))
