"""Retention: which keys a full cache would drop, and the recent-event history.

Eviction picks the lowest ``k`` keys of an instance by a policy score: histograms
narrow the scores down to the range of the last one, and only the keys up to it are
ranked, by the skew-safe dense position (range slices).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.sequence import dense_position
from sluice.session import checked_broadcast, write_table

NO_TTL = -1          # Redis TTL of a key without expiry
LAST_RESORT = 999999  # TTL-LRU score of keys without a positive TTL
# Eviction reasons of the reference.
REASONS = {"LRU": "LRU_POLICY", "TTL": "TTL_POLICY", "TTL-LRU": "TTL_LRU_POLICY"}


def cache_snapshot(log: DataFrame, ttl_seconds: int, now: Column, fixed_anchor: DataFrame | None = None) -> DataFrame:
    """State of every key at ``now`` under each policy's expiry rule.

    remaining = seconds until expiry (floor), like Redis ``TTL``:
    * LRU keys are set without expiry (-1); the first hit adds the TTL from
      the last access.
    * TTL keys expire ``ttl`` after their last set (``fixed_anchor``: the
      last miss of the key under the fixed rule; defaults to the first access).
    * TTL-LRU keys expire ``ttl`` after their last access.
    Keys whose TTL ran out are no longer in the cache.
    """
    per_key = log.filter(F.col("ts") <= now).groupBy("instance", "key").agg(
        F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last_access"), F.min("ts").alias("first_access"),
        F.max(now).alias("_now"))
    if fixed_anchor is not None:
        per_key = per_key.join(fixed_anchor, ["instance", "key"], "left")
    else:
        per_key = per_key.withColumn("last_set", F.col("first_access"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    now_us = us(F.col("_now"))
    ttl_us = ttl_seconds * 1_000_000
    rem_access = F.floor((us(F.col("last_access")) + ttl_us - now_us) / 1_000_000).cast("long")
    rem_set = F.floor((us(F.col("last_set")) + ttl_us - now_us) / 1_000_000).cast("long")
    lru_ttl = F.when(F.col("accesses") > 1, rem_access).otherwise(F.lit(NO_TTL))
    rows = F.explode(F.array(
        F.struct(F.lit("LRU").alias("policy"), lru_ttl.alias("ttl")),
        F.struct(F.lit("TTL").alias("policy"), rem_set.alias("ttl")),
        F.struct(F.lit("TTL-LRU").alias("policy"), rem_access.alias("ttl")),
    ))
    snap = per_key.select("instance", "key", rows.alias("r")).select("instance", "key", "r.policy", "r.ttl")
    alive = (F.col("ttl") == NO_TTL) | (F.col("ttl") > 0)
    return snap.filter(alive)


def eviction_score(policy: Column, ttl: Column) -> Column:
    """LRU: TTL ascending (no-TTL keys first); TTL: TTL (only > 0); TTL-LRU: TTL, non-positive last."""
    return (F.when(policy == "TTL-LRU", F.when(ttl > 0, ttl).otherwise(F.lit(LAST_RESORT)))
            .when(policy == "TTL", F.when(ttl > 0, ttl))
            .otherwise(ttl))


#: Ranges of scores in one round of the selection, and its rounds.
RANGES, ROUNDS = 256, 4


def lowest(scored: DataFrame, sizes: DataFrame, by: list[str], score: str, count: str, enough: int = 4) -> DataFrame:
    """Rows of ``scored`` that hold the ``count`` lowest scores of each group ``by`` (``sizes``: a row a group, with
    ``count``), and not many more: a histogram of the scores between the group's bounds tells in which range the last
    one lies, and the next round looks into that range only. Rows above it never leave their task. A group is narrow
    enough when the border range holds at most ``count`` / ``enough`` rows, or one score.
    """
    bounds = (scored.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi")).join(sizes.select(*by, count), by)
              .where(F.col(count) > 0).withColumns({"_need": F.col(count), "_done": F.lit(False)}))
    for _ in range(ROUNDS):
        bounds = write_table(bounds, "bounds")  # a row a group
        if bounds.where("NOT _done").isEmpty():
            break
        width = F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.lit(RANGES)).cast("long")
        open_ = checked_broadcast(bounds).where("NOT _done")
        inside = scored.join(open_, by).where(F.col(score).between(F.col("_lo"), F.col("_hi")))
        hist = inside.groupBy(*by, F.floor((F.col(score) - F.col("_lo")) / width).cast("long").alias("_r")).agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy(*by).orderBy("_r")  # at most RANGES rows a group
        hist = hist.withColumn("_sum", F.sum("_c").over(upto)).join(open_, by)
        border = hist.where(F.col("_sum") >= F.col("_need")).groupBy(*by).agg(F.min_by(F.struct("_r", "_c", "_sum"), "_r").alias("_b"))
        low = F.col("_lo") + F.col("_b._r") * width
        next_ = bounds.join(border, by, "left").withColumns({"_low": low, "_high": F.least(low + width - 1, F.col("_hi"))})
        moved = F.col("_b").isNotNull()
        bounds = next_.select(
            *by, count, F.when(moved, F.col("_low")).otherwise(F.col("_lo")).alias("_lo"), F.when(moved, F.col("_high")).otherwise(F.col("_hi")).alias("_hi"),
            F.when(moved, F.col("_need") - (F.col("_b._sum") - F.col("_b._c"))).otherwise(F.col("_need")).alias("_need"),
            (~moved | (F.col("_b._c") * enough <= F.col(count)) | (F.col("_low") == F.col("_high"))).alias("_done"))
    limits = checked_broadcast(write_table(bounds.select(*by, F.col("_hi").alias("_limit")), "bounds"))
    return scored.join(limits, by).where(F.col(score) <= F.col("_limit")).drop("_limit")


def evict_candidates(snapshot: DataFrame, cap: int, min_one: bool = True) -> DataFrame:
    """Keys removed by one eviction pass per (policy, instance): when the cache
    holds n >= cap keys, the ``max(1, floor(0.1 n))`` (or ``floor(0.1 n)`` with
    ``min_one=False``) lowest-scored keys; ties broken by key.

    The keys that stay are not sorted: ``lowest`` selects by histograms, and only what it
    leaves, the removed keys and the rest of the border range, gets ranks.
    """
    by = ["policy", "instance"]
    scored = write_table(snapshot.withColumn("score", eviction_score(F.col("policy"), F.col("ttl"))), "scored")
    k = F.floor(F.col("n") * 0.1)
    if min_one:
        k = F.greatest(F.lit(1), k)
    sizes = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.when(F.col("n") >= cap, k).otherwise(F.lit(0)).cast("long"))
    sizes = write_table(sizes, "sizes")  # a row a cache
    sizes = checked_broadcast(sizes)
    ranked = dense_position(lowest(scored.where(F.col("score").isNotNull()), sizes, by, "score", "k"), by, ["score", "key"], "rank")
    out = ranked.join(sizes, by, "inner").filter(F.col("rank") <= F.col("k"))
    return out.select("policy", "instance", "key", "ttl", "score", "rank",
                      F.col("n").alias("cache_size_before"),
                      F.element_at(F.create_map(*[x for kv in REASONS.items() for x in map(F.lit, kv)]),
                                   F.col("policy")).alias("reason"))


def eviction_events(distances: DataFrame, seq_log: DataFrame, size: int) -> DataFrame:
    """Evictions of a least-recently-used cache of ``size`` keys per instance: every miss once the cache is
    full pushes one key out. Columns of ``seq_log`` plus reason, evicted_count and size_before.

    ``distances`` has the reuse distance of re-accesses. The cache is full after the ``size``-th cold access,
    found among the first ``size`` cold accesses of each instance.
    """
    s = seq_log.join(distances.select("instance", "pos", "reuse_distance"), ["instance", "pos"], "left")
    first = Window.partitionBy("instance").orderBy("pos")  # a limit: tasks pass on at most ``size`` rows each
    cold = s.filter(F.col("reuse_distance").isNull()).select("instance", "pos")
    full = cold.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= size).groupBy("instance").agg(
        F.max("pos").alias("_full"), F.count(F.lit(1)).alias("_keys")).filter(F.col("_keys") == size)
    miss = s.filter(F.col("reuse_distance").isNull() | (F.col("reuse_distance") >= size))
    return (miss.join(full, "instance").filter(F.col("pos") > F.col("_full"))
            .withColumns({"reason": F.lit(REASONS["LRU"]), "evicted_count": F.lit(1), "size_before": F.lit(size)})
            .drop("_full", "_keys", "reuse_distance"))


def recent_history(events: DataFrame, group_cols: list[str], order_col: str, k: int = 10) -> DataFrame:
    """Last ``k`` events per group (top-k by ``order_col`` desc, ties by ``seq``). Spark limits each task's
    rows of a group to ``k`` before the shuffle, so a hot group sends at most ``k`` rows a task."""
    w = Window.partitionBy(*group_cols).orderBy(F.col(order_col).desc(), F.col("seq").desc())
    return events.withColumn("recency_rank", F.row_number().over(w)).filter(F.col("recency_rank") <= k)
