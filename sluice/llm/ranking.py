"""Ranked lexical search: term-at-a-time over short lists, then document-at-a-time over long ones.

1. Documents are read once into shards: for each shard the postings of the asked terms, the lengths of its
   documents in ascending doc_id, and its counts. No text goes further.
2. The counts of all shards give N, L and the document frequencies, hence the weights.
3. A shard answers each item by a hybrid: the short posting lists are summed into accumulators, which then
   are one more sorted list with a bound. Document-at-a-time evaluation walks spans of documents in order;
   a span is skipped if the bounds of the long lists and of the accumulators in it cannot reach the item's
   threshold. In other spans a document is a candidate only if its accumulator and the long lists' bounds
   reach it, and each long list is probed at the candidates that are left.
4. A few shards (a square root of their number) are searched first: their best documents give every item a
   threshold that all other shards start with.

Items are taken in blocks of terms, so that what a block broadcasts (its terms, their weights, its items) is
bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._packed import pack, runs, unpack
from sluice.llm._ranks import running_total
from sluice.session import write_table

K = 50
#: Documents and text bytes of a shard at most (one document at least).
SHARD_DOCS, SHARD_BYTES = 1 << 16, 64 << 20
#: Distinct terms that one block of items asks for, about (a longer item is a block of its own).
BLOCK_TERMS = 100_000
#: A list with at most this share of a shard's documents is short; documents of a span.
SHORT, SPAN = 1 / 32, 512
#: Every byte of a term stands for itself, A-Z for their lower case; all others separate.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Stands for a null doc_id: after all others.
LAST = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text in UTF-8, A-Z lower-cased."""
    return (text or b"").translate(_TABLE).split()


def asked_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term), once each; rows of one item_id are one item."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in zip(batch.column(0), batch.column(1), strict=True):
                terms = sorted(set(terms_of(body.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(terms), pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])

    return items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text")).mapInArrow(cut, "item_id long, term binary").distinct()


def index_shards(docs: DataFrame, terms: list[bytes], shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES,
                 text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a shard: n_docs (with a term), n_terms, and packed postings of ``terms`` (numbers from 0): doc_ids in
    ascending order, null ones last, their numbers of terms, borders of the lists, places in the lists and
    occurrences, and the numbers of the terms that occur."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i + 1 for i, t in enumerate(shared.value)}.get
        ids: list[int] = []
        lengths: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal held
            who, n = np.array(ids, dtype=np.int64), np.array(lengths, dtype=np.int64)
            order = np.argsort(who, kind="stable")
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            where = np.repeat(place, [len(t) for t, _ in found]) if found else np.empty(0, np.uint32)
            term = np.concatenate([t for t, _ in found]) if found else np.empty(0, np.uint32)
            often = np.concatenate([c for _, c in found]) if found else np.empty(0, np.uint32)
            by = np.lexsort((where, term))
            where, term, often = where[by], term[by], often[by]
            border = runs(term)
            value = pack(who[order], n[order], term[border[:-1]], border.astype(np.uint32), where, often)
            row = pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([value], pa.binary())],
                                             names=["n_docs", "n_terms", "postings"])
            ids.clear()
            lengths.clear()
            found.clear()
            held = 0
            return row

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = body.as_py()
                words = terms_of(raw)
                count = Counter(filter(None, map(number, words)))
                ids.append(LAST if key is None else key)
                lengths.append(len(words))
                found.append((np.fromiter(count.keys(), np.uint32, len(count)) - np.uint32(1), np.fromiter(count.values(), np.uint32, len(count))))
                held += len(raw or b"")
                if len(ids) >= shard_docs or held >= shard_bytes:
                    yield out()
        if ids:
            yield out()

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(index, "n_docs long, n_terms long, postings binary")


def document_frequencies(shards: DataFrame) -> DataFrame:
    """(term, df) for the numbers of terms that occur."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                _, _, term, border, *_ = unpack(value.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(np.diff(border.astype(np.int64)))], names=["term", "df"])

    return shards.select("postings").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 - 50 + (50 * length * N) div L of each document."""
    if not len(lengths) or not total:
        return np.full(len(lengths), 50, dtype=np.int64)
    if 50 * int(lengths.max()) * n < 1 << 63:
        return 50 + 50 * lengths * np.int64(n) // np.int64(total)
    return np.array([50 + 50 * x * n // total for x in lengths.tolist()], dtype=np.int64)


class Shard:
    """The postings of one shard with the scores and bounds of every list."""

    def __init__(self, value: bytes, weights: np.ndarray, n: int, total: int, short: float = SHORT, span: int = SPAN):
        self.ids, lengths, self.terms, border, self.where, often = unpack(value)
        self.border = border.astype(np.int64)
        often = often.astype(np.int64)
        w = np.repeat(weights[self.terms], np.diff(self.border))
        m = norms(lengths, n, total)
        self.score = w * ((1_000_000_000 * often) // (1000 * often + 20 * m[self.where]))
        self.short, self.span = max(1, int(short * len(self.ids))), span
        self.spans = -(-len(self.ids) // span)
        self.bounds: dict[int, np.ndarray] = {}

    def lists(self, terms: np.ndarray) -> list[int]:
        """Places of the given terms (sorted numbers) among those that occur here."""
        if not len(self.terms):
            return []
        at = np.searchsorted(self.terms, terms)
        at = np.minimum(at, len(self.terms) - 1)
        return at[self.terms[at] == terms].tolist()

    def bound(self, i: int) -> np.ndarray:
        """The highest score of a long list in each span (kept for the next item)."""
        if i not in self.bounds:
            a, b = self.border[i], self.border[i + 1]
            top = np.zeros(self.spans, dtype=np.int64)
            np.maximum.at(top, self.where[a:b] // self.span, self.score[a:b])
            self.bounds[i] = top
        return self.bounds[i]

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the best ``k`` documents with a score of ``least`` or more (and above 0), best
        first, and how many documents were scored."""
        lists = self.lists(terms)
        size = np.diff(self.border)
        short, long = [i for i in lists if size[i] <= self.short], [i for i in lists if size[i] > self.short]
        # term at a time: the accumulators of the short lists, as one list sorted by document
        if short:
            where = np.concatenate([self.where[self.border[i] : self.border[i + 1]] for i in short]).astype(np.int64)
            score = np.concatenate([self.score[self.border[i] : self.border[i + 1]] for i in short])
            acc, inverse = np.unique(where, return_inverse=True)
            summed = np.zeros(len(acc), dtype=np.int64)
            np.add.at(summed, inverse, score)
        else:
            acc, summed = np.empty(0, np.int64), np.empty(0, np.int64)
        top = np.zeros(self.spans, dtype=np.int64)
        np.maximum.at(top, acc // self.span, summed)
        # document at a time: spans in order, lists by falling bound
        long.sort(key=lambda i: -int(self.bound(i).max()))
        bounds = np.stack([self.bound(i) for i in long]) if long else np.zeros((0, self.spans), np.int64)
        total = bounds.sum(0)
        border = np.searchsorted(acc, np.arange(self.spans + 1) * self.span)
        places, scores, threshold, scored = np.empty(0, np.int64), np.empty(0, np.int64), max(1, least), 0
        for s in np.flatnonzero(total + top >= threshold).tolist():
            if total[s] + top[s] < threshold:
                continue  # the threshold has risen
            mine, partial = acc[border[s] : border[s + 1]], summed[border[s] : border[s + 1]]
            if total[s] >= threshold:  # documents of the long lists alone may reach it
                first = s * self.span
                partial_ = np.zeros(min(self.span, len(self.ids) - first), dtype=np.int64)
                partial_[mine - first] = partial
                mine, partial = np.arange(first, first + len(partial_)), partial_
            rest = int(total[s])
            for i, bound in zip(long, bounds[:, s].tolist(), strict=True):
                keep = partial + rest >= threshold
                mine, partial = mine[keep], partial[keep]
                if not len(mine):
                    break
                a, b = self.border[i], self.border[i + 1]
                at = np.minimum(np.searchsorted(self.where[a:b], mine), b - a - 1)
                partial = partial + np.where(self.where[a:b][at] == mine, self.score[a:b][at], 0)
                rest -= bound
            scored += len(mine)
            keep = partial >= threshold
            if keep.any():
                places, scores = np.concatenate([places, mine[keep]]), np.concatenate([scores, partial[keep]])
                if len(places) > k:
                    at = np.lexsort((places, -scores))[:k]
                    places, scores = places[at], scores[at]
                    # later documents have larger places: an equal score loses the tie here
                    threshold = max(threshold, int(scores[-1]) + 1)
        at = np.lexsort((places, -scores))[:k]
        return places[at], scores[at], scored


def search_shards(shards: DataFrame, items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, n: int, total: int, k: int = K,
                  least: dict[int, int] | None = None, short: float = SHORT, span: int = SPAN) -> DataFrame:
    """(item, doc_id, score): of each shard and each item (by its place in ``items``) the best ``k`` documents
    that reach the item's threshold in ``least``."""
    shared = shards.sparkSession.sparkContext.broadcast((items, weights, least or {}))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w, thresholds = shared.value
        for batch in batches:
            for value in batch.column(0):
                shard = Shard(value.as_py(), w, n, total, short, span)
                who, what, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i, (_, terms) in enumerate(asked):
                    places, scores, _ = shard.search(terms, k, thresholds.get(i, 1))
                    who.append(np.full(len(places), i))
                    what.append(shard.ids[places])
                    score.append(scores)
                ids = np.concatenate(what)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.array(ids, mask=ids == LAST), pa.array(np.concatenate(score))],
                                                 names=["item", "doc_id", "score"])

    return shards.select("postings").mapInArrow(search, "item long, doc_id long, score long")


def _blocks(asked: DataFrame, block_terms: int) -> list[int]:
    """The numbers of the blocks in the column ``block`` of stored items with their number of terms."""
    return sorted(r[0] for r in asked.select("block").distinct().collect())


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, shard_docs: int = SHARD_DOCS,
                  shard_bytes: int = SHARD_BYTES, short: float = SHORT, span: int = SPAN, text: str = "text", doc_id: str = "doc_id",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank (from 1), doc_id, score.

    The score sums, over an item's distinct terms, weight * ((10^9 * tf) div (1000 * tf + 20 * m)), with weight =
    floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 50 + (50 * n * N) div L; only scores above 0 count, ties go
    to the smaller doc_id, a null one last. Null and empty texts hold no term; items without a known term have
    no row; rows with one item_id are one item; repeated documents are documents of their own.
    """
    spark = docs.sparkSession
    asked = write_table(asked_terms(items, item_id, item_text), "asked")
    sizes = write_table(asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("_terms")).withColumn("_all", F.lit(0)), "items")
    blocks = write_table(running_total(sizes, ["_all"], ["item_id"], F.col("_terms"), "_upto").select(
        F.col("item_id").alias("_item"), F.floor((F.col("_upto") - 1) / block_terms).alias("block")), "blocks")
    found = None
    for block in _blocks(blocks, block_terms):
        mine = asked.join(blocks.where(F.col("block") == block), F.col("item_id").eqNullSafe(F.col("_item"))).select("item_id", "term").collect()
        terms = sorted({bytes(r["term"]) for r in mine})
        number = {t: i for i, t in enumerate(terms)}
        of: dict[int | None, list[int]] = {}
        for r in mine:
            of.setdefault(r["item_id"], []).append(number[bytes(r["term"])])
        queries = [(i, np.array(sorted(of[i]), dtype=np.uint32)) for i in sorted(of, key=lambda i: (i is None, i or 0))]
        shards = write_table(index_shards(docs, terms, shard_docs, shard_bytes, text, doc_id).withColumn("shard", F.monotonically_increasing_id()), "shards")
        n, total, count = shards.agg(F.sum("n_docs"), F.sum("n_terms"), F.count(F.lit(1))).first()
        n, total = int(n or 0), int(total or 0)
        weights = np.zeros(len(terms), dtype=np.int64)
        for r in document_frequencies(shards).collect():  # at most the block's terms
            weights[r["term"]] = weight(n, r["df"])
        # thresholds from a square root of the shards, spread by hash
        seeds = math.isqrt(count)
        if seeds > 1:
            first = shards.where(F.pmod(F.xxhash64("shard"), F.lit(count)) < seeds)
            best = search_shards(first, queries, weights, n, total, k, None, short, span)
            order = Window.partitionBy("item").orderBy(F.desc("score"))
            kth = best.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("item", "score").collect()  # a row an item
            least = {r["item"]: r["score"] for r in kth}
        else:
            least = {}
        hits = search_shards(shards, queries, weights, n, total, k, least, short, span)
        names = spark.createDataFrame([(i, q[0]) for i, q in enumerate(queries)], "item long, item_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        rows = write_table(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")  # a block's items: bounded
        found = rows if found is None else found.union(rows)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found
