"""Counting points below and to the left of query points, for groups of any size.

``dominance_counts`` answers, for every query (x, y) of a group, how many of the group's points have a
position of at most x and a value of at most y. Positions 1..n are a tree: a node of a level holds
``FANOUT`` children of ``BLOCK * FANOUT**level`` positions. On the way down a query adds the points of the
children before its own, and keeps the rank of its value among the points of its child. A node's points in
order of their values are cut into chunks of ``CHUNK``; each pandas group is one chunk with its queries, or
one block of the lowest level; if very many queries meet there, they are dealt to parts that each hold its
points. What lies in earlier chunks comes as at most ``FANOUT`` running totals a chunk,
so no group and no table of totals grows faster than the points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import checked_broadcast, write_table

#: Positions of a block of the lowest level, children of a node, and values of a chunk.
BLOCK, FANOUT, CHUNK = 1 << 17, 256, 1 << 16

POINT, QUERY, TOTAL = 0, 1, 2
_ITEM = "kind byte, x long, r long, id long, tag int, acc long"


def weighted_smaller_before(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For every i: the sum of w[j] over j < i with v[j] < v[i]. Values are ranked; from the highest bit of the
    ranks down, an element with bit 1 adds the earlier ones of its group (equal higher bits) with bit 0."""
    rank = np.unique(v, return_inverse=True)[1].astype(np.int64)
    out, order = np.zeros(len(v), dtype=np.int64), np.arange(len(v))
    for b in reversed(range(int(rank.max(initial=0)).bit_length())):
        r = rank[order]
        group, bit = r >> (b + 1), (r >> b) & 1
        add = np.where(bit == 0, w[order], 0)
        zeros = np.cumsum(add) - add
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        base = np.repeat(zeros[head], np.diff(np.append(head, len(r))))
        out[order] += np.where(bit == 1, zeros - base, 0)
        order = order[np.argsort(r >> b, kind="stable")]
    return out


def _prefix_below(child: np.ndarray, upto: np.ndarray, c: np.ndarray, fanout: int, step: int = 256) -> np.ndarray:
    """For every query: how many of the first ``upto`` entries of ``child`` are below ``c``. Totals at every
    ``step`` entries, and the rest compared entry by entry."""
    chunks = -(-len(child) // step) + 1
    padded = np.full(chunks * step, fanout, dtype=np.int64)
    padded[: len(child)] = child
    table = np.zeros((chunks, fanout + 1), dtype=np.int64)
    if len(child):
        np.add.at(table, (np.arange(len(child)) // step + 1, child + 1), 1)
    table = table.cumsum(0).cumsum(1)
    padded = padded.reshape(chunks, step)
    at = upto // step
    out = table[at, c]
    for i in range(0, len(c), 4096):
        j = slice(i, i + 4096)
        rows = padded[at[j]]
        out[j] += ((rows < c[j, None]) & (np.arange(step) < (upto[j] - at[j] * step)[:, None])).sum(1)
    return out


def _descend(frame: pd.DataFrame, size: int, fanout: int) -> pd.DataFrame:
    """One chunk of a node: points learn their rank in their child, queries add the children before theirs."""
    kind, x, r = frame["kind"].to_numpy(), frame["x"].to_numpy(np.int64), frame["r"].to_numpy(np.int64)
    base = np.zeros(fanout, dtype=np.int64)
    totals = kind == TOTAL
    base[x[totals]] = frame["acc"].to_numpy(np.int64)[totals]
    child = (x - 1) // size % fanout
    points = np.flatnonzero(kind == POINT)
    points = points[np.argsort(r[points], kind="stable")]
    cp = child[points]
    by = np.argsort(cp, kind="stable")
    first = np.searchsorted(cp[by], np.arange(fanout))
    inside = np.empty(len(points), dtype=np.int64)
    inside[by] = np.arange(len(points)) - first[cp[by]]
    rank = r.copy()
    rank[points] = base[cp] + inside + 1
    acc = frame["acc"].to_numpy(np.int64).copy()
    queries = np.flatnonzero(kind == QUERY)
    if len(queries):
        cq = child[queries]
        upto = np.searchsorted(r[points], r[queries], side="right")
        key = cp[by] * (len(points) + 1) + by  # sorted by (child, place)
        equal = np.searchsorted(key, cq * (len(points) + 1) + upto) - first[cq]
        below = np.concatenate([[0], np.cumsum(base)])
        acc[queries] += below[cq] + _prefix_below(cp, upto, cq, fanout)
        rank[queries] = base[cq] + equal
    keep = ~totals & ((kind == QUERY) | (frame["part"].to_numpy() == 0))  # points are in every part
    out = frame[["instance", "kind", "x", "id", "tag"]][keep]
    return out.assign(r=rank[keep], acc=acc[keep])[["instance", "kind", "x", "r", "id", "tag", "acc"]]


def _descend_to(size: int, fanout: int):
    return lambda frame: _descend(frame, size, fanout)


def _lowest(frame: pd.DataFrame) -> pd.DataFrame:
    """One block of positions: its points counted for its queries."""
    order = np.lexsort((frame["kind"].to_numpy(), frame["r"].to_numpy()))
    kind, x = frame["kind"].to_numpy()[order], frame["x"].to_numpy(np.int64)[order]
    found = weighted_smaller_before(2 * x + (kind == QUERY), (kind == POINT).astype(np.int64))
    queries = kind == QUERY
    out = frame[["instance", "id", "tag"]].iloc[order[queries]]
    return out.assign(n=frame["acc"].to_numpy(np.int64)[order[queries]] + found[queries])


def _parted(items: DataFrame, stored: DataFrame, group: list[str], most: int) -> DataFrame:
    """``items`` with ``part``: a group with more than ``most`` queries is cut into parts, each with all of its points
    and totals. Any number of queries may ask for one position. ``stored`` is a table of the same queries."""
    many = stored.where(F.col("kind") == QUERY).groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce(F.col("parts"), F.lit(1))
    own = F.array(F.pmod(F.xxhash64("id", "tag"), parts).cast("int"))
    return (items.join(checked_broadcast(write_table(many, "parts")), group, "left")
            .withColumn("part", F.explode(F.when(F.col("kind") == QUERY, own).otherwise(F.sequence(F.lit(0), parts - 1)))).drop("parts"))


def levels_of(n: int, block: int = BLOCK, fanout: int = FANOUT) -> int:
    """Levels above the lowest for groups of ``n`` positions."""
    level = 0
    while block * fanout**level < n:
        level += 1
    return level


def dominance_counts(points: DataFrame, queries: DataFrame, n: int, block: int = BLOCK, fanout: int = FANOUT, chunk: int = CHUNK) -> DataFrame:
    """(instance, id, tag, n): the number of points of the instance with position <= x and value <= y.

    ``points`` has instance, x (distinct positions 1..n of an instance) and y (at least 0; at most one point
    of an instance for each value above 0; any number for 0). ``queries`` has instance, id, tag, x and y; a
    query with x < 1 or y < 0 counts nothing.
    """
    kind = points.schema["instance"].dataType.simpleString()
    # points of value 0 get values below 0 of their own, so that a range of values holds as many points at most
    p = points.select("instance", F.lit(POINT).cast("byte").alias("kind"), "x", F.when(F.col("y") > 0, F.col("y")).otherwise(-F.col("x")).alias("r"),
                      F.lit(0).cast("long").alias("id"), F.lit(0).alias("tag"), F.lit(0).cast("long").alias("acc"))
    q = queries.where("x >= 1 AND y >= 0").select("instance", F.lit(QUERY).cast("byte").alias("kind"), "x", F.col("y").alias("r"), F.col("id").cast("long").alias("id"),
                                                 F.col("tag").cast("int").alias("tag"), F.lit(0).cast("long").alias("acc"))
    items = p.unionByName(q)
    top = levels_of(n, block, fanout)
    schema = f"instance {kind}, {_ITEM}"
    for level in range(top, 0, -1):
        size = block * fanout ** (level - 1)  # of a child
        node = F.floor((F.col("x") - 1) / F.lit(size * fanout)).cast("long")
        place = F.col("r") + n if level == top else F.col("r") - 1
        items = write_table(items.withColumns({"node": node, "chunk": F.floor(F.greatest(place, F.lit(0)) / F.lit(chunk)).cast("long")}), "dominance")
        cell = ["instance", "node", "child"]
        cells = (items.where(F.col("kind") == POINT).withColumn("child", F.pmod(F.floor((F.col("x") - 1) / F.lit(size)), F.lit(fanout)).cast("long"))
                 .groupBy(*cell, "chunk").agg(F.count(F.lit(1)).alias("c")))
        # each child's points before every chunk of its node that holds a point or a query
        grid = items.select("instance", "node", "chunk").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fanout - 1).cast("long"))).alias("child"))
        before = Window.partitionBy(*cell).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        totals = (grid.withColumn("c", F.lit(0).cast("long")).unionByName(cells).groupBy(*cell, "chunk").agg(F.sum("c").alias("c"))
                  .withColumn("acc", F.coalesce(F.sum("c").over(before), F.lit(0))).where("acc > 0")
                  .select("instance", F.lit(TOTAL).cast("byte").alias("kind"), F.col("child").alias("x"), F.lit(0).cast("long").alias("r"),
                          F.lit(0).cast("long").alias("id"), F.lit(0).alias("tag"), "acc", "node", "chunk"))
        parted = _parted(items.unionByName(totals), items, ["instance", "node", "chunk"], 4 * chunk)
        items = parted.groupBy("instance", "node", "chunk", "part").applyInPandas(_descend_to(size, fanout), schema)
    items = write_table(items.withColumn("node", F.floor((F.col("x") - 1) / F.lit(block)).cast("long")), "dominance")
    lowest = _parted(items, items, ["instance", "node"], 2 * block).groupBy("instance", "node", "part")
    found = lowest.applyInPandas(_lowest, f"instance {kind}, id long, tag int, n long")
    none = queries.where("x < 1 OR y < 0").select("instance", F.col("id").cast("long").alias("id"), F.col("tag").cast("int").alias("tag"), F.lit(0).cast("long").alias("n"))
    return found.unionByName(none)
