"""Sharding: best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._ranks import running_total

#: A group of at least ``total / (shards * PARTS)`` bytes is an item of its own; smaller groups travel in
#: ``shards * PARTS`` hash bundles. So the driver packs at most ``2 * shards * PARTS`` items, whatever the input.
PARTS = 512


class RemainingTree:
    """Open bins in a balanced search tree (a treap) ordered by (remaining capacity, bin)."""

    __slots__ = ("root", "draw")

    def __init__(self) -> None:
        self.root, self.draw = None, random.Random(5)

    # a node is [key, priority, left, right]
    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, t, key):
        """Keys below ``key``, and the others."""
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            t[3] = a
            return t, b
        a, b = self._split(t[2], key)
        t[2] = b
        return a, t

    def add(self, key: tuple[int, int]) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, self.draw.random(), None, None]), b)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that still holds ``size``."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            self.root = a
            return None
        key = b
        while key[2] is not None:
            key = key[2]
        _, rest = self._split(b, (key[0][0], key[0][1] + 1))
        self.root = self._merge(a, rest)
        return key[0]


def best_fit_decreasing(items: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[int] | None:
    """Bins of ``items`` (size, name), which are sorted by falling size, in bins of ``capacity``.

    Each item enters the tightest open bin that holds it, else a new one. None if more than ``most``
    bins would be opened or an item exceeds the capacity.
    """
    tree, bins, opened = RemainingTree(), [], 0
    for size, _ in items:
        if size > capacity:
            return None
        found = tree.take_tightest(size)
        if found is None:
            if most is not None and opened >= most:
                return None
            found, opened = (capacity, opened), opened + 1
        bins.append(found[1])
        tree.add((found[0] - size, found[1]))
    return bins


def pack_items(items: list[tuple[int, int]], shards: int) -> tuple[list[int], int]:
    """Bins of items in ``shards`` bins of the least capacity (to a 4000th of the mean) that suffices."""
    total = sum(s for s, _ in items)
    low = max([-(-total // shards), *(s for s, _ in items[:1])])
    step, grow = max(1, low // 4000), 1
    best = best_fit_decreasing(items, low, shards)
    if best is not None:
        return best, low
    while (best := best_fit_decreasing(items, low + grow * step, shards)) is None:
        grow *= 2
    fails, works = grow // 2, grow
    while works - fails > 1:
        middle = (works + fails) // 2
        tried = best_fit_decreasing(items, low + middle * step, shards)
        if tried is None:
            fails = middle
        else:
            works, best = middle, tried
    return best, low + works * step


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id",
                    parts: int = PARTS) -> DataFrame:
    """Put all documents into ``shards`` shards of nearly equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot (gapless from 0
    inside the shard). Groups are equal texts, so a group larger than a mean shard makes its shard that
    large and the others share the rest. Null and empty texts have size 1 and are one group; repeated
    rows each get a slot; a null doc_id is kept; an empty table gives no rows. The groups are summed in
    Spark with partial sums; the driver sees at most ``2 * shards * parts`` items.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(1), body).alias("_g1"), F.xxhash64(F.lit(2), body).alias("_g2"),
    )
    bundles = shards * parts
    groups = rows.groupBy("_g1", "_g2").agg(F.sum("size").alias("_bytes"))
    total = docs.agg(F.sum(F.octet_length(body) + 1)).first()[0] or 0
    large = max(1, -(-total // bundles))
    bundle = F.pmod(F.col("_g1"), F.lit(bundles)).cast("int")
    own = F.col("_bytes") >= large
    items = (groups.groupBy(F.when(own, F.lit(-1)).otherwise(bundle).alias("bundle"),
                            F.when(own, F.col("_g1")).alias("g1"), F.when(own, F.col("_g2")).alias("g2"))
             .agg(F.sum("_bytes").alias("bytes")).collect())
    items = sorted(items, key=lambda r: (-r["bytes"], r["bundle"], r["g1"] or 0, r["g2"] or 0))
    bins, _ = pack_items([(int(r["bytes"]), i) for i, r in enumerate(items)], shards) if items else ([], 0)
    alone = [(r["g1"], r["g2"], b) for r, b in zip(items, bins, strict=True) if r["bundle"] < 0]
    shared = [(r["bundle"], b) for r, b in zip(items, bins, strict=True) if r["bundle"] >= 0]
    # both lists are bounded by the parameters: at most ``bundles`` rows each
    alone_df = F.broadcast(spark.createDataFrame(alone, "_g1 long, _g2 long, _alone int"))
    shared_df = F.broadcast(spark.createDataFrame(shared, "_bundle int, _shared int"))
    placed = (rows.withColumn("_bundle", bundle).join(alone_df, ["_g1", "_g2"], "left").join(shared_df, ["_bundle"], "left")
              .select("doc_id", "size", "text_crc32", F.coalesce("_alone", "_shared").cast("int").alias("shard")))
    ranked = running_total(placed, ["shard"], ["doc_id", "size", "text_crc32"], F.lit(1), "_rank")
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - 1).cast("long").alias("slot"))
