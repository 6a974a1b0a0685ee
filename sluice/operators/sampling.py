"""Workload tables: uniform and weighted draws with replacement.

Draws are reproducible: a draw is a hash of seed and number, so the same draws
come out of Spark and the SQL oracle. Items are addressed by a dense index, or by
prefix sums of their weights, built without a global window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.numeric import idiv
from sluice.functions.scoring import SPACE, hash32, hash60
from sluice.operators.sequence import global_dense_id, slice_count, stored_slices

# The 80/20 workload of the reference (50 frequent items share
# 0.8 of the draws, the rest share 0.2).
FREQUENT_ITEMS = 50
FREQUENT_SHARE = 0.8
RARE_SHARE = 0.2
SCALE_U = 4294967296.0  # 2^32


def draw_u(seed: int, *cols: str) -> Column:
    """Uniform u in [0, 1) from the first 32 bits of md5(seed:cols...)."""
    return hash32(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])) / SCALE_U


def indexed(items: DataFrame, id_col: str = "id") -> DataFrame:
    return global_dense_id(items, [id_col], id_col="idx")


def sample_with_replacement(items: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Exactly ``n`` uniform draws (``random.choice`` in a loop): draw number ``j`` and ``drawn_id``. No item, no draw."""
    idx = indexed(items.select(id_col), id_col)
    total = items.agg(F.count(F.lit(1)).alias("n"))  # one row
    d = items.sparkSession.range(n).withColumnRenamed("id", "j").crossJoin(total)
    d = d.withColumn("target", (F.floor(draw_u(seed, "j") * F.col("n")) + 1).cast("long"))
    return d.join(idx, d["target"] == idx["idx"], "inner").select("j", F.col(id_col).alias("drawn_id"))


#: Draws of one task, about.
DRAWS_PER_TASK = 1_000_000


def weighted_sample(items: DataFrame, n: int, weight: str, seed: int = 7, id_col: str = "id", scale: int = 1_000_000,
                    per_task: int = DRAWS_PER_TASK, num_partitions: int | None = None) -> DataFrame:
    """Exactly ``n`` draws with replacement, each item with probability weight / total: draw number ``j`` and
    ``drawn_id``. No item with a weight above 0, no draw.

    Weights of any numeric type become whole units, floor(weight * scale); null, negative and zero ones are never
    drawn. Items lie in a row by id. Units are summed in two levels, per range slice and inside it. A draw is a
    place in the row, md5(seed:j) scaled to the total; the bounds of the slices deal it to one, and there the items'
    bounds to one of them. Draws of a slice are shared out over as many tasks as they need, so an item with most of
    the weight is no hot task.
    """
    spark = items.sparkSession
    units = items.select(F.col(id_col).alias("id"), F.floor(F.col(weight).cast("decimal(28,10)") * scale).cast("long").alias("units")).where("units > 0")
    s = stored_slices(units, [], ["id"], slice_count(units, num_partitions))
    totals = {r["_pid"]: int(r["t"]) for r in s.groupBy("_pid").agg(F.sum(F.col("units").cast("decimal(38,0)")).alias("t")).collect()}  # a row a slice
    pids, bounds = sorted(totals), [0]
    for p in pids:
        bounds.append(bounds[-1] + totals[p])
    total = bounds[-1]
    kind = s.schema["id"].dataType.simpleString()
    if not total:
        return spark.createDataFrame([], f"j long, drawn_id {kind}")
    if total >= 1 << 62:
        raise ValueError(f"the weights sum to {total / scale:g}: take a smaller scale than {scale}")
    shares = [max(1, -(-n * totals[p] // total // per_task)) for p in pids]
    place = idiv(hash60(F.concat_ws(":", F.lit(str(seed)), F.col("j").cast("string"))).cast("decimal(20,0)") * F.lit(total).cast("decimal(19,0)"), F.lit(SPACE).cast("decimal(20,0)"))
    draws = spark.range(n).select(F.col("id").alias("j")).withColumn("place", place.cast("long"))
    edges = np.array(bounds[1:], dtype=np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.searchsorted(edges, pdf["place"].to_numpy(), side="right")
            share = pdf["j"].to_numpy() % np.array(shares)[at]
            yield pd.DataFrame({"slice": at, "share": share, "j": pdf["j"], "place": pdf["place"].to_numpy() - np.array(bounds)[at]})

    def resolve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id")
        ends = np.cumsum(right["units"].to_numpy(np.int64))
        return pd.DataFrame({"j": left["j"], "drawn_id": right["id"].to_numpy()[np.searchsorted(ends, left["place"].to_numpy(), side="right")] if len(left) else []})

    dealt = draws.mapInPandas(deal, "slice long, share long, j long, place long")
    places = spark.createDataFrame([(p, i, shares[i]) for i, p in enumerate(pids)], "_pid int, slice long, shares long")
    held = s.join(F.broadcast(places), "_pid").select("slice", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "id", "units")  # a row a slice
    return dealt.groupBy("slice", "share").cogroup(held.groupBy("slice", "share")).applyInPandas(resolve, f"j long, drawn_id {kind}")


def union_workload(items: DataFrame, id_col: str = "id") -> DataFrame:
    """Frequent and rare item tables concatenated with their per-item weight."""
    idx = indexed(items.select(id_col), id_col)
    n = items.agg(F.count(F.lit(1)).alias("n"))
    t = idx.crossJoin(n)
    freq = t.filter(F.col("idx") <= FREQUENT_ITEMS).select(
        id_col, F.lit("frequent").alias("kind"),
        (F.lit(FREQUENT_SHARE) / F.least(F.col("n"), F.lit(FREQUENT_ITEMS))).alias("weight"))
    rare = t.filter(F.col("idx") > FREQUENT_ITEMS).select(
        id_col, F.lit("rare").alias("kind"), (F.lit(RARE_SHARE) / (F.col("n") - FREQUENT_ITEMS)).alias("weight"))
    return freq.unionByName(rare)
