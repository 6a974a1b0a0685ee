"""Quartiles, ranges and histograms of raw values from mergeable quantile sketches.

One pass over the rows fills a KLL sketch for each group, partially in every task; sketches merge, so results of
days or folders can be kept and combined. Everything else reads the sketches: no value is sorted and no second pass
finds the range. A sketch of size ``k`` has a rank error of about 1.7 / k (``rank_errors`` measures it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import checked_broadcast, write_table

#: Size of a sketch: some 10 kB, and a rank error of about 0.2 %.
K = 800
QUARTILES = (0.25, 0.5, 0.75)
#: Quantiles that a histogram is read from.
POINTS = 1000


def sketches(rows: DataFrame, value: str, by: Sequence[str], k: int = K) -> DataFrame:
    """A row a group: ``by``, n, lo, hi and sketch. Null and NaN values count nowhere."""
    v = F.col(value).cast("double")
    kept = rows.withColumn("_v", v).where(v.isNotNull() & ~F.isnan(v))
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.kll_sketch_agg_double("_v", k).alias("sketch"))


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of ``sketches`` over parts of the data as one row a group."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double("sketch").alias("sketch"))


def box(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Box panel: n, lo, q1, median, q3, hi of each group."""
    q = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(c) for p, c in zip(QUARTILES, ("q1", "median", "q3"), strict=True)]
    return found.select(*by, "n", "lo", *q, "hi")


def histogram(found: DataFrame, by: Sequence[str], buckets: int) -> DataFrame:
    """Violin panel: ``buckets`` equal ranges [from, to) between a group's own lo and hi (the last one holds hi), and
    about how many values lie in each: of ``POINTS`` quantiles of the sketch, those below its ends."""
    points = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit((p + 0.5) / POINTS) for p in range(POINTS)]))
    i = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("i")
    edge = lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * j / buckets
    below = lambda j: F.when(j >= buckets, F.lit(1.0)).otherwise(F.size(F.filter("_points", lambda q: q < edge(j))) / POINTS)
    rows = found.withColumn("_points", points).select("*", i)
    count = F.round((below(F.col("i") + 1) - below(F.col("i"))) * F.col("n")).cast("long")
    return rows.select(*by, (F.col("i") + 1).alias("bucket"), edge(F.col("i")).alias("from"), edge(F.col("i") + 1).alias("to"), count.alias("n"))


def rank_errors(rows: DataFrame, value: str, boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """How far each quartile's rank is from the one it stands for, as a share of the group's rows (0: an exact quartile)."""
    b = checked_broadcast(write_table(boxes, "boxes"))  # a row a group
    v = F.col(value).cast("double")
    aggs = []
    for p, c in zip(QUARTILES, ("q1", "median", "q3"), strict=True):
        less, upto = F.count_if(F.col("_v") < F.col(c)) / F.count(F.lit(1)), F.count_if(F.col("_v") <= F.col(c)) / F.count(F.lit(1))
        aggs.append(F.greatest(F.lit(0.0), less - p, F.lit(p) - upto).alias(f"{c}_error"))
    return rows.withColumn("_v", v).where(v.isNotNull() & ~F.isnan(v)).select(*by, "_v").join(b, list(by)).groupBy(*by).agg(*aggs)
