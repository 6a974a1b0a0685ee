"""Ordered scans within groups that stay parallel when one group is huge.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here
the rows are range partitioned on ``(group, order)`` instead, so a hot group is
spread over several tasks by count. Each task numbers / lags its own slice with
a window on ``(group, task)``; the first row of each slice is then stitched to
the previous slice through a per-slice summary whose size is bounded by the
number of slices of a group (<= number of range partitions).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import cut_lineage, scratch_path


SLICE_BYTES = 64 * 1024 * 1024


def slice_count(df: DataFrame, num_partitions: int | None) -> int:
    """Number of range slices: one per ~64 MB of the optimizer's size estimate, at most the session's
    ``spark.sql.shuffle.partitions`` (estimates of joins are products, far too high)."""
    if num_partitions:
        return int(num_partitions)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SLICE_BYTES)))


#: Rows of a slice that a pandas group holds; more rows make more slices.
HELD_ROWS = 1 << 18


def held_slices(df: DataFrame, num_partitions: int | None) -> int:
    """Number of range slices for steps that hold a slice in Python: one per ``HELD_ROWS`` rows, however many there
    are. File sizes do not tell the rows, and a bound on the slices would let them grow with the data."""
    return int(num_partitions) if num_partitions else max(1, -(-df.count() // HELD_ROWS))


def sliced(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], n: int) -> DataFrame:
    """Range partition on (group, order) and tag each row with its slice ``_pid``.

    The range bounds come from sampling, and after an upstream shuffle the row
    order (hence the sample) is not deterministic, so two plans reading the same
    exchange could disagree on slices. The tagged rows are therefore written
    once to the checkpoint folder; every later branch reads the same slices,
    also after an executor is lost.
    """
    keys = [F.col(c).asc_nulls_first() for c in list(group_cols) + list(order_cols)]
    return cut_lineage(df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()))


def stored_slices(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], n: int) -> DataFrame:
    """The slices of ``sliced`` as a table with a folder a slice: a read that names slices opens no other."""
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in list(group_cols) + list(order_cols)]
    tagged = df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id())
    path = scratch_path(spark, "slices")
    tagged.write.partitionBy("_pid").parquet(path)
    return spark.read.schema(tagged.schema).parquet(path)


def sequence_within(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    lag_cols: Sequence[str] = (),
    lead_cols: Sequence[str] = (),
    pos_col: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``prev_<c>`` for ``lag_cols``, ``next_<c>`` for ``lead_cols`` and an
    optional dense 1-based position ``pos_col`` within each group.

    ``order_cols`` must be a total order inside a group (add a unique
    tie-breaker), otherwise results are not deterministic.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    n = slice_count(df, num_partitions)
    r = sliced(df, group_cols, order_cols, n)
    slice_cols = group_cols + ["_pid"]
    w = Window.partitionBy(*slice_cols).orderBy(*[F.col(c) for c in order_cols])
    wd = Window.partitionBy(*slice_cols).orderBy(*[F.col(c).desc() for c in order_cols])

    for c in lag_cols:
        r = r.withColumn(f"prev_{c}", F.lag(c).over(w))
    for c in lead_cols:
        r = r.withColumn(f"next_{c}", F.lead(c).over(w))
    r = r.withColumn("_rn", F.row_number().over(w))
    if lead_cols:
        r = r.withColumn("_rn_desc", F.row_number().over(wd))

    # one summary row per (group, slice): first/last row values and the count
    order_struct = F.struct(*[F.col(c) for c in order_cols])
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    if lag_cols:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in lag_cols]), order_struct).alias("_last"))
    if lead_cols:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in lead_cols]), order_struct).alias("_first"))
    summ = r.groupBy(*slice_cols).agg(*aggs)
    ws = Window.partitionBy(*group_cols).orderBy("_pid")
    carry = [F.col(c) for c in slice_cols]
    if lag_cols:
        carry.append(F.lag("_last").over(ws).alias("_carry_prev"))
    if lead_cols:
        carry.append(F.lead("_first").over(ws).alias("_carry_next"))
    if pos_col:
        carry.append(
            F.coalesce(F.sum("_cnt").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset")
        )
    summ = summ.select(*carry)

    out = r.join(summ, on=slice_cols, how="left")
    for c in lag_cols:
        out = out.withColumn(f"prev_{c}", F.when(F.col("_rn") == 1, F.col("_carry_prev")[c]).otherwise(F.col(f"prev_{c}")))
    for c in lead_cols:
        out = out.withColumn(
            f"next_{c}", F.when(F.col("_rn_desc") == 1, F.col("_carry_next")[c]).otherwise(F.col(f"next_{c}"))
        )
    if pos_col:
        out = out.withColumn(pos_col, (F.col("_offset") + F.col("_rn")).cast("long"))
    drop = [c for c in ("_pid", "_rn", "_rn_desc", "_carry_prev", "_carry_next", "_offset") if c in out.columns]
    return out.drop(*drop)


def previous_in_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                      value_cols: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Skew-safe ``lag``: adds ``prev_<c>`` for each value column."""
    return sequence_within(df, group_cols, order_cols, lag_cols=value_cols, num_partitions=num_partitions)


def next_in_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                  value_cols: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Skew-safe ``lead``: adds ``next_<c>`` for each value column."""
    return sequence_within(df, group_cols, order_cols, lead_cols=value_cols, num_partitions=num_partitions)


def dense_position(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], pos_col: str = "pos",
                   num_partitions: int | None = None) -> DataFrame:
    """Dense 1-based row number within each group, without a one-task window."""
    return sequence_within(df, group_cols, order_cols, pos_col=pos_col, num_partitions=num_partitions)


def global_dense_id(df: DataFrame, order_cols: Sequence[str], id_col: str = "id",
                    num_partitions: int | None = None) -> DataFrame:
    """``surrogate_key``: dense 1..n ids in ``order_cols`` order (SERIAL on load).

    Range partition -> per-partition count -> prefix offset -> local row number;
    never a global un-partitioned window.
    """
    tmp = df.withColumn("_all", F.lit(0))
    out = dense_position(tmp, ["_all"], order_cols, pos_col=id_col, num_partitions=num_partitions)
    return out.drop("_all")
