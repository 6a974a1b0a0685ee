"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are sorted by length and packed in buckets of similar length. A query's score with a bucket's
vectors is at most the product of lengths; against the query's running threshold this gives a local
cosine threshold. Above 1 the bucket is pruned. A high one prunes by coordinate (the query's largest
coordinate must lie in the feasible range of the candidate's), a low one by length (the bucket's first
vectors, which are long enough). What remains is verified by its exact integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._packed import pack, unpack
from sluice.session import write_table

K = 20
#: Vectors of a bucket, queries of a block, and buckets that meet in one task's group.
BUCKET, QUERIES, TOGETHER = 4096, 512, 8
#: Full buckets of the longest vectors that give every query its first threshold.
SEEDS = 2
#: Lengths that stand for all groups of buckets when a block of queries looks up how far down it must go.
MARKS = 65_536
#: From this local cosine threshold on a bucket is pruned by coordinate, below by length.
COORDINATE = 0.5
_EXACT = float(1 << 53)


def quantised(vectors: DataFrame, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, vec (floor(scale * x) of each component x as double) and its length; vectors that are null or
    hold null or non-finite components, and rows without vec_id, take no part; repeated rows count once."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull()).where(finite)
    vec = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec")).distinct()
    return rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))


def _matrix(lists: list, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    if all(len(v) == width for v in lists):
        return np.array([np.asarray(v) for v in lists], dtype=np.int64).reshape(len(lists), width)
    m = np.zeros((len(lists), width), dtype=np.int64)
    for i, v in enumerate(lists):
        m[i, : len(v)] = v
    return m


def _packed(ids: np.ndarray, matrix: np.ndarray, norms: np.ndarray, *more: np.ndarray) -> bytes:
    """Components in the smallest integer type that holds them."""
    top = int(np.abs(matrix).max()) if matrix.size else 0
    kind = np.int8 if top < 128 else np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
    return pack(ids, norms, np.array([matrix.shape[1]], np.int64), matrix.astype(kind).ravel(), *more)


def _unpacked(value: bytes) -> tuple:
    ids, norms, width, flat, *more = unpack(bytes(value))
    return ids, norms, flat.reshape(len(ids), int(width[0])), *more


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows: by floating point where every partial sum is exact, else by integers."""
    d = max(queries.shape[1], vectors.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) if m.shape[1] < d else m for m in (queries, vectors))
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * d
    if top < _EXACT:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_bucket(q_ids: np.ndarray, q_norms: np.ndarray, queries: np.ndarray, least: np.ndarray, at_least: np.ndarray, ids: np.ndarray,
                  norms: np.ndarray, vectors: np.ndarray, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, vec_ids, scores) of a bucket's best ``k`` that reach the query's threshold ``least``.

    ``norms`` fall; a score equal to the threshold stays if its vec_id is at most ``at_least``, that of the
    k-th best vector known: a larger one loses the tie.
    """
    slack = 1e-9
    longest = float(norms[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q_norms * longest > 0, least / (q_norms * longest), np.where(least > 0, np.inf, -np.inf))
    cosine = np.where(np.isnan(cosine), -np.inf, cosine)
    by_length = np.flatnonzero(cosine <= min(COORDINATE, 1 + slack))
    for i in range(0, len(by_length), 64):
        group = by_length[i : i + 64]
        # every vector whose length alone allows the group's lowest threshold
        need = np.min(np.where(q_norms[group] > 0, least[group] / np.maximum(q_norms[group], 1e-300), -np.inf))
        n = int(np.searchsorted(-norms, -need * (1 - slack) if need > 0 else np.inf, side="right"))
        scores = products(queries[group], vectors[:n])
        for j, q in enumerate(group):
            yield from _take(q_ids[q], scores[j], ids[:n], least[q], at_least[q], k)
    by_coordinate = np.flatnonzero((cosine > COORDINATE) & (cosine <= 1 + slack))
    if len(by_coordinate):
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.where(norms[:, None] > 0, vectors / norms[:, None], 0.0).T.copy()
        for q in by_coordinate:
            t = min(1.0, float(cosine[q]))
            direction = queries[q] / q_norms[q]
            f = int(np.abs(direction).argmax())
            x = float(direction[f])
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-6
            low, high = t * x - spread, t * x + spread
            # the cap of directions with cosine >= t reaches the pole where the query's coordinate exceeds t
            low, high = (-np.inf, np.inf) if len(unit) <= f else (low if x > -t else -np.inf, high if x < t else np.inf)
            at = np.flatnonzero((unit[f] >= low) & (unit[f] <= high)) if f < len(unit) else np.arange(len(ids))
            if len(at):
                yield from _take(q_ids[q], products(queries[q : q + 1], vectors[at])[0], ids[at], least[q], at_least[q], k)


def _take(q_id: int, scores: np.ndarray, ids: np.ndarray, least: float, at_least: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    keep = ((scores > least) | ((scores == least) & (ids <= at_least))) & (ids != q_id)
    ids, scores = ids[keep], scores[keep]
    if len(ids):
        at = best(ids, scores, k)
        yield int(q_id), ids[at], scores[at]


def needed_length(norms: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Length that a vector must have to reach each query's threshold; without a threshold or length, any will do."""
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where((norms > 0) & (least > 0), least / np.maximum(norms, 1e-300), -np.inf)
    return need * (1 - 1e-9)


def in_groups(buckets: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``buckets`` with ``grp``: those of ``together`` neighbouring ranges of falling length (the upper bits of
    ``bucket``) share one, so group numbers rise as lengths fall."""
    return buckets.withColumn("grp", F.floor(F.shiftright("bucket", 33) / F.lit(together)).cast("int"))


def marks_of(numbered: DataFrame, count: int = MARKS) -> tuple[np.ndarray, np.ndarray]:
    """At most about ``count`` marks (the last group that a mark stands for, the longest length among its groups), in order."""
    last = numbered.agg(F.max("grp")).first()[0]
    stride = 1 if last is None else -(-(last + 1) // count)
    rows = numbered.groupBy(F.floor(F.col("grp") / F.lit(stride)).alias("mark")).agg(F.max("grp"), F.max("longest")).collect()
    found = sorted((r[1], r[2]) for r in rows)
    return np.array([g for g, _ in found], dtype=np.int64), np.array([x for _, x in found], dtype=np.float64)


def groups_down_to(marks: tuple[np.ndarray, np.ndarray], need: float) -> int:
    """Group numbers below this may hold a vector of length ``need``."""
    at = np.flatnonzero(marks[1] >= need)
    return int(marks[0][at[-1]]) + 1 if len(at) else 0


def ask(blocks: DataFrame) -> DataFrame:
    """One row for each group of buckets that a block of queries cannot rule out by its length."""
    return blocks.where(F.col("upto") > 0).select("asked", F.explode(F.sequence(F.lit(0), F.col("upto") - 1)).alias("grp"))


def top_k(vectors: DataFrame, k: int = K, every: int = 20, bucket: int = BUCKET, queries: int = QUERIES, seeds: int = SEEDS,
          vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """The ``k`` highest integer products of every query (rows whose vec_id is divisible by ``every``) with all
    other rows, ties to smaller vec_id: query_id, rank (from 1), vec_id, score. Fewer rows give fewer answers;
    vectors of different widths are filled with zeros; an empty table gives no rows. Components whose products could
    leave 64 bits are an error."""
    spark = vectors.sparkSession
    rows = write_table(quantised(vectors, scale, vec_id, embedding), "vectors")
    n, width, most, least = rows.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(F.array_max("vec")), F.min(F.array_min("vec"))).first()
    width = int(width or 0)
    top = max(int(most or 0), -int(least or 0))
    if top * top * width >= 1 << 63:
        raise ValueError(f"{embedding}: components of {top / scale:g} are too large for 64-bit products")
    # 1. buckets of falling length; a hash breaks ties, so that one very common vector fills many buckets
    parts = max(1, -(-n // bucket))
    sorted_ = rows.repartitionByRange(parts, F.desc("norm"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("norm"), F.xxhash64("vec_id"))

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, vec, norms = (list(c) for c in zip(*held, strict=True))
            value = _packed(np.array(ids, np.int64), _matrix(vec, width), np.array(norms))
            return pa.RecordBatch.from_arrays([pa.array([norms[0]]), pa.array([value], pa.binary())], names=["longest", "packed"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append(row)
                if len(held) == bucket:
                    yield out()
                    held = []
        if held:
            yield out()

    buckets = write_table(sorted_.select("vec_id", "vec", "norm").mapInArrow(in_buckets, "longest double, packed binary")
                          .withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    # 2. first thresholds from the longest vectors, about seeds * bucket of them
    count = buckets.count()
    enough = -(-seeds * bucket * count // max(n, 1))  # buckets may hold fewer vectors than they could
    first = [_unpacked(r["packed"]) for r in buckets.orderBy(F.desc("longest"), "bucket").limit(enough).collect()]
    shared = spark.sparkContext.broadcast(first)

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_ids = np.concatenate([x[0] for x in shared.value]) if shared.value else np.empty(0, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, queries):
                part = batch.slice(i, queries)
                ids, norms = part.column(0).to_numpy(), part.column(2).to_numpy()
                matrix = _matrix(part.column(1).to_pylist(), width)
                scores = np.concatenate([products(matrix, x[2]) for x in shared.value], 1) if shared.value else np.empty((len(ids), 0))
                least, at_least = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
                for j in range(len(ids)):
                    other = seed_ids != ids[j]
                    top = best(seed_ids[other], scores[j][other], k)
                    if len(top) == k:
                        least[j], at_least[j] = scores[j][other][top[-1]], seed_ids[other][top[-1]]
                arrays = [part.column(0), part.column(1), part.column(2), pa.array(least), pa.array(at_least, pa.int64()), pa.array(needed_length(norms, least))]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "vec", "norm", "least", "at_least", "need"])

    ready = rows.where(F.col("vec_id") % every == 0).select("vec_id", "vec", "norm").mapInArrow(
        thresholds, "vec_id long, vec array<long>, norm double, least double, at_least long, need double")
    ready = write_table(ready, "queries")
    # 3. queries that need vectors of similar length form a block, which meets the groups of buckets down to that length
    numbered = in_groups(buckets)
    marks = marks_of(numbered)

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, queries):
                part = batch.slice(i, queries)
                ids, norms, least, at_least, need = (part.column(c).to_numpy() for c in (0, 2, 3, 4, 5))
                value = _packed(ids, _matrix(part.column(1).to_pylist(), width), norms, least, at_least)
                upto = groups_down_to(marks, float(need.min()))
                yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary()), pa.array([upto], pa.int32())], names=["asked", "upto"])

    blocks = ready.repartitionByRange(max(1, -(-ready.count() // (8 * queries))), F.desc("need"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("need"))
    blocks = write_table(blocks.mapInArrow(in_blocks, "asked binary, upto int"), "query-blocks")
    asked = ask(blocks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_, packed in zip(batch.column(0), batch.column(1), strict=True):
                q_ids, q_norms, q_matrix, least, at_least = _unpacked(asked_.as_py())
                ids, norms, matrix = _unpacked(packed.as_py())
                who, what, score = [], [], []
                for q, i, s in search_bucket(q_ids, q_norms, q_matrix.astype(np.int64), least, at_least, ids, norms, matrix, k):
                    who.append(np.full(len(i), q, dtype=np.int64))
                    what.append(i)
                    score.append(s)
                if who:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (who, what, score)], names=["query_id", "vec_id", "score"])

    found = asked.join(numbered, "grp").select("asked", "packed").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, matrix: np.ndarray, every: int, k: int) -> pd.DataFrame:
    """The same answers from all products at once (for tests)."""
    out = []
    for i in np.flatnonzero(ids % every == 0):
        scores = matrix.astype(np.int64) @ matrix[i].astype(np.int64)
        others = np.flatnonzero(ids != ids[i])
        for rank, at in enumerate(others[best(ids[others], scores[others], k)], 1):
            out.append((int(ids[i]), rank, int(ids[at]), int(scores[at])))
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
