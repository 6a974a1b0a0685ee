"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import write_table

#: Edges that one contraction task holds.
EDGES_PER_TASK = 1_000_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and for each the smallest node of its component."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        nodes, root = roots_of(f["a"].to_numpy(), f["b"].to_numpy())
        keep = nodes != root
        yield pd.DataFrame({"a": nodes[keep], "b": root[keep]})


def shared_token_edges(members: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """Edges (a, b) that connect all nodes which share a token.

    ``members``: rows (a: node, b: token, linked: false), and edges found already (a, b: nodes, linked: true).
    Rows meet by token and each task sends a star forest of its nodes only, so the tokens go no further.
    """
    members = write_table(members, "members")
    alone = members.where("not linked")
    tasks = 1 + alone.count() // edges_per_task

    def stars(f: pd.DataFrame) -> pd.DataFrame:
        node, token = f["a"].to_numpy(), f["b"].to_numpy()
        by = np.argsort(token, kind="stable")
        node, token = node[by], token[by]
        same = token[1:] == token[:-1]
        return next(_contract(iter([pd.DataFrame({"a": node[1:][same], "b": node[:-1][same]})])))

    shares = alone.withColumn("_share", F.pmod(F.xxhash64("b"), F.lit(tasks)).cast("int"))
    return members.where("linked").select("a", "b").union(shares.groupBy("_share").applyInPandas(stars, "a long, b long"))


def connected_components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, root) for every node that has an edge to another node; root is the component's smallest node.

    ``edges`` has long columns a and b. First each task contracts a bounded share of the edges to a
    star forest; then rounds of large and small stars link the forests until no edge changes. Each
    round is written to the checkpoint folder; the driver gets one row of counts a round.
    """
    edges = write_table(edges.select("a", "b").where("a <> b"), "edges")
    n = edges.count()
    tasks = -(-n // edges_per_task)
    if not n:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    shares = edges.withColumn("_share", F.pmod(F.xxhash64(F.greatest("a", "b")), F.lit(tasks)).cast("int"))
    star = write_table(shares.groupBy("_share").applyInPandas(lambda f: next(_contract(iter([f]))), "a long, b long"), "star")
    if tasks > 1:
        last = None
        while True:
            both = star.union(star.select("b", "a")).toDF("u", "v")
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = (large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                     .union(least.select("u", "m")).where("a <> b").distinct())
            star = write_table(small, "star")
            now = tuple(star.agg(F.count(F.lit(1)), F.countDistinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if now == last and now[0] == now[1]:
                break
            last = now
    return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
