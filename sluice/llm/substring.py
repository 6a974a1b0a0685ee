"""Substring dedup: Rabin-Karp hashes of every token window, counted in Spark; repeats are confirmed by a long hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._packed import pack, runs, unpack
from sluice.llm._text import U64, Words, blocks, table_bytes, windows

WIDTH = 20
#: Text bytes hashed at once by a task; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Text bytes whose windows meet in one counting task, about.
BUCKET_BYTES = 8 << 20
#: Stands for a null doc_id: after all others.
LAST = np.iinfo(np.int64).max


def _merge(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of adjacent window starts per document; the input is sorted by (doc, first)."""
    if not len(doc):
        return doc, first, last
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)])
    border = np.flatnonzero(new)
    return doc[border], first[border], np.maximum.reduceat(last, border)


def _starts(cand: bytes | None) -> np.ndarray:
    """The window starts of packed runs [from, to]."""
    if not cand:
        return np.empty(0, np.int64)
    a, b = unpack(bytes(cand))
    return np.repeat(a - np.concatenate([[0], np.cumsum(b - a + 1)[:-1]]), b - a + 1) + np.arange(int((b - a + 1).sum()))


def _short(texts: list[bytes | None], width: int, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of text, start) of every window: the number of the counting task above 32 bits of hash.
    ``bits`` of the hash are kept."""
    words = Words(texts)
    rolled, text, start = windows(words.hashes(), words.offsets, width)
    if bits < 64:
        rolled = rolled & U64((1 << bits) - 1)
    return (_task(rolled, buckets) << U64(32) | (rolled & U64((1 << 32) - 1)))[:, None], text, start


def _task(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The counting task of a hash, by its upper 24 bits."""
    return ((hashes >> U64(40)) * U64(buckets)) >> U64(24)


def _strong(texts: list[bytes | None], width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two columns of hash, index of text, start) of every window: the task above 40 bits, and 48 bits."""
    words = Words(texts)
    word = words.hashes(128)
    (low, text, start), (high, _, _) = (windows(np.ascontiguousarray(word[:, i]), words.offsets, width) for i in (0, 1))
    return np.stack([_task(low, buckets) << U64(40) | (low & U64((1 << 40) - 1)), high >> U64(16)], 1), text, start


def _borders(keys: np.ndarray) -> np.ndarray:
    """Borders of runs of equal rows of sorted keys."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])


def _by_document(doc: np.ndarray, start: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Window starts as runs, for the merging task of their document."""
    by = np.lexsort((start, doc))
    doc, a, b = _merge(doc[by], start[by], start[by])
    target = _target(doc, buckets)
    by = np.argsort(target, kind="stable")
    for i, j in _spans(target[by]):
        part = by[i:j]
        yield buckets + int(target[part[0]]), pack(doc[part], a[part], b[part])


def _local(block: dict[str, list], width: int, buckets: int, strong: bool, bits: int) -> Iterator[tuple[int, bytes]]:
    """Windows of a block: the earliest of each hash for the counting task of its range, the others, which certainly
    repeat, for the merging task of their document. The first pass (not ``strong``) tells candidates: a window that
    others of the block repeat is one too. The second takes the windows that start at ``block["cand"]``."""
    ids = np.array([LAST if x is None else x for x in block["doc_id"]], dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], [block["text"][i] for i in order]
    hashes, text, start = _strong(texts, width, buckets) if strong else _short(texts, width, buckets, bits)
    if strong:
        border = np.searchsorted(text, np.arange(len(texts) + 1))
        at = [border[k] + s[s < border[k + 1] - border[k]] for k, s in enumerate(_starts(block["cand"][i]) for i in order)]
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        hashes, text, start = hashes[at], text[at], start[at]
    if not len(hashes):
        return
    by = np.lexsort((*hashes.T[1:], hashes[:, 0]))  # stable: within equal hashes by (doc_id, start), but for repeated rows
    hashes, text, start = hashes[by], text[by].astype(np.uint32), start[by].astype(np.uint32)
    border = _borders(hashes)
    size = np.diff(border)
    head = np.repeat(border[:-1], size)
    first = np.zeros(len(hashes), dtype=bool)
    first[border[:-1]] = True
    again = ~first & ~((ids[text] == ids[text[head]]) & (start == start[head]))
    told = again if strong else np.logical_or.reduceat(again, border[:-1]).repeat(size)
    if told.any():
        yield from _by_document(ids[text[told]], start[told], buckets)
    hashes, text, start = hashes[first], text[first], start[first]
    bucket = hashes[:, 0] >> U64(40 if strong else 32)
    for i, j in _spans(bucket):
        present, inverse = np.unique(text[i:j], return_inverse=True)
        # the task is known, and only the bits below it travel
        keys = [hashes[i:j, 0].astype(np.uint32)]
        if strong:
            keys += [(hashes[i:j, 0] >> U64(32)).astype(np.uint8), hashes[i:j, 1].astype(np.uint32), (hashes[i:j, 1] >> U64(32)).astype(np.uint16)]
        yield int(bucket[i]), pack(*keys, ids[present], inverse.astype(np.uint32), start[i:j])


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    border = runs(keys)
    return list(zip(border[:-1].tolist(), border[1:].tolist(), strict=True))


def _target(doc: np.ndarray, buckets: int) -> np.ndarray:
    return ((doc.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(33)) % U64(buckets)


def _count(frame: pd.DataFrame, buckets: int, strong: bool) -> pd.DataFrame:
    """Windows of one range of hashes that repeat, by document: all of them in the first pass, in the second those
    that are not the earliest of their hash."""
    key = int(frame["bucket"].iloc[0])
    if key >= buckets:
        return frame
    hashes, ids, places, starts, held = [], [], [], [], 0
    for value in frame["packed"]:
        *keys, present, inverse, s = unpack(value)
        a, *more = [k.astype(U64) for k in keys]
        hashes.append(np.stack([a | more[0] << U64(32), more[1] | more[2] << U64(32)], 1) if strong else a)
        ids.append(present)
        places.append(inverse + np.uint32(held))
        starts.append(s)
        held += len(present)
    h, ids, place, start = np.concatenate(hashes), np.concatenate(ids), np.concatenate(places), np.concatenate(starts)
    del hashes, places, starts
    by = np.lexsort((h[:, 1], h[:, 0])) if strong else np.argsort(h, kind="stable")
    h = h[by]
    equal = (h[1:] == h[:-1]).all(1) if strong else h[1:] == h[:-1]
    twin = np.zeros(len(h), dtype=bool)
    twin[1:] |= equal
    twin[:-1] |= equal
    by = by[twin]
    h, doc, start = h[twin], ids[place[by]], start[by]
    h = h if strong else h[:, None]
    by = np.lexsort((start, doc, *h.T[1:], h[:, 0]))
    h, doc, start = h[by], doc[by], start[by]
    border = _borders(h)
    size = np.diff(border)
    head = np.repeat(border[:-1], size)
    again = (doc != doc[head]) | (start != start[head])
    if not strong and len(again):
        again = np.logical_or.reduceat(again, border[:-1]).repeat(size)
    return pd.DataFrame(list(_by_document(doc[again], start[again], buckets)), columns=["bucket", "packed"])


def _candidates(frame: pd.DataFrame) -> pd.DataFrame:
    """Runs [from, to] of window starts, packed by document."""
    parts = [unpack(v) for v in frame["packed"]]
    doc, a, b = (np.concatenate([p[i] for p in parts]) for i in range(3))
    by = np.lexsort((a, doc))
    doc, a, b = doc[by], a[by].astype(np.int64), b[by].astype(np.int64)
    shift = doc_rank(doc) * (1 << 40)
    reach = np.maximum.accumulate(b + shift)
    new = np.concatenate([[True], (a + shift)[1:] > reach[:-1] + 1])
    border = np.flatnonzero(new)
    stop = np.concatenate([border[1:], [len(doc)]]) - 1
    low, high, who = a[border], reach[stop] - shift[stop], doc[border]
    out = [(None if who[i] == LAST else int(who[i]), pack(low[i:j], high[i:j])) for i, j in _spans(who)]
    return pd.DataFrame(out, columns=["_id", "_cand"]).astype({"_id": "Int64"})


def _intervals(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """Maximal removal intervals [from, to) in words, packed by document."""
    parts = [unpack(v) for v in frame["packed"]]
    doc, a, b = (np.concatenate([p[i] for p in parts]) for i in range(3))
    by = np.lexsort((a, doc))
    doc, a, b = doc[by], a[by].astype(np.int64), b[by].astype(np.int64) + width
    # runs of starts that touch or overlap once a window's width is added; a running maximum inside a document
    reach = np.maximum.accumulate(b + doc_rank(doc) * (1 << 40)) if len(doc) else b
    begin = a + doc_rank(doc) * (1 << 40)
    new = np.concatenate([[True], begin[1:] > reach[:-1]]) if len(doc) else np.empty(0, bool)
    border = np.flatnonzero(new)
    stop = np.concatenate([border[1:], [len(doc)]]) - 1
    rank = doc_rank(doc)
    low, high, who = a[border], reach[stop] - rank[stop] * (1 << 40), doc[border]
    out = [(None if who[i] == LAST else int(who[i]), np.stack([low[i:j], high[i:j]]).tobytes()) for i, j in _spans(who)]
    return pd.DataFrame(out, columns=["_id", "_removed"]).astype({"_id": "Int64"})


def doc_rank(doc: np.ndarray) -> np.ndarray:
    """0, 1, ... for the runs of a sorted array."""
    return np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)])) if len(doc) else doc


def repeated_intervals(rows: DataFrame, doc_id: str, text: str, width: int = WIDTH, bits: int = 64) -> DataFrame:
    """Documents with words covered by a window of ``width`` words that also starts earlier (in a smaller
    doc_id, or earlier in the same document): ``_id`` and ``_removed``, the maximal intervals [from, to) in
    words as two rows of 64-bit numbers. ``doc_id`` (a long) and ``text`` (string or binary) are columns of ``rows``, or
    fields; ``bits`` is the length of the filter's hash.

    Two passes. The first is a filter: every window's short hash is sent to the counting task of its hash range, once
    per block of texts (a hot passage sends one entry a block), and windows whose hash is found twice are candidates.
    The second decides: candidates meet by another hash, from BLAKE2b with 128 bits of their words: 88 bits of it and
    the task's number (95 bits over 1 GB, 112 over 100 TB). No window is cut for a short hash that another happens to
    share, and the earliest start stays. Its join reads all columns of ``rows``: a
    caller that joins the same ``rows`` with the result shuffles the texts once. All numbers move as packed columns.
    Null texts have no window. Rows with one doc_id are one document: a window at the same place of another such row is
    not earlier. A null doc_id comes last.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    buckets = 1 + table_bytes(spark, plain, ["text"]) // BUCKET_BYTES

    def counted(found: DataFrame, id_at: str, text_at: str, strong: bool) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = {"doc_id": _field(batch, id_at), "text": _field(batch, text_at).cast(pa.binary())}
                if strong:
                    columns["cand"] = _field(batch, "_cand")
                for block in blocks(iter([pa.RecordBatch.from_pydict(columns)]), "text", BLOCK_BYTES):
                    for key, value in _local(block, width, buckets, strong, bits):
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([value], pa.binary())], names=["bucket", "packed"])

        packed = "bucket long, packed binary"
        return found.mapInArrow(deal, packed).groupBy("bucket").applyInPandas(lambda f: _count(f, buckets, strong), packed)

    candidates = counted(plain, "doc_id", "text", False).groupBy("bucket").applyInPandas(_candidates, "_id long, _cand binary")
    joined = rows.join(candidates, F.col(doc_id).eqNullSafe(F.col("_id")))
    return counted(joined, doc_id, text, True).groupBy("bucket").applyInPandas(lambda f: _intervals(f, width), "_id long, _removed binary")


def _field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of an Arrow batch, or a field of a struct column."""
    column, *inner = name.split(".")
    found = batch.column(batch.schema.names.index(column))
    for field in inner:
        found = pc.struct_field(found, field)
    return found


def _covered(words: int, removed: bytes | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(kept, removed) intervals of a text of so many words."""
    gone = [(min(a, words), min(b, words)) for a, b in np.frombuffer(removed, np.int64).reshape(2, -1).T.tolist()] if removed else []
    gone = [(a, b) for a, b in gone if a < b]
    kept, at = [], 0
    for a, b in gone:
        if at < a:
            kept.append((at, a))
        at = b
    if at < words:
        kept.append((at, words))
    return kept, gone


def removal_digest(docs: DataFrame, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id", bits: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)
    and removed, the intervals as an array of [from, to) in words."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    found = repeated_intervals(rows, "doc_id", "text", width, bits)
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "_removed")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha, spans = [], [], [], []
            for body, removed in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = (body.as_py() or b"").split()
                kept, gone = _covered(len(words), removed)
                left = [w for a, b in kept for w in words[a:b]] if gone else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
                spans.append([{"from": a, "to": b} for a, b in gone])
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, span)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    return joined.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<from:long,to:long>>")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; its other columns stay, but n_chars counts anew.

    A cut takes the words of an interval and the white space after them; a text without cuts stays as it is.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), F.struct("*").alias("_row"))
    found = repeated_intervals(rows, "_d", "_row.text", width)
    joined = rows.join(found, F.col("_d").eqNullSafe(F.col("_id")), "left")

    @F.pandas_udf("string")
    def cut(bodies: pd.Series, removed: pd.Series) -> pd.Series:
        out = []
        for body, gone_ in zip(bodies, removed, strict=True):
            if body is None or not gone_:
                out.append(body)
                continue
            words = Words([body.encode()])
            n = len(words.starts)
            kept, _ = _covered(n, gone_)
            ends = [int(words.starts[b]) if b < n else len(words.raw) - 1 for _, b in kept]
            starts = [1 if a == 0 else int(words.starts[a]) for a, _ in kept]
            out.append(b"".join(words.raw[a:b] for a, b in zip(starts, ends, strict=True)).decode())
        return pd.Series(out, dtype=object)

    changed = joined.withColumn("_new", F.when(F.col("_removed").isNotNull(), cut(F.col("_row.text"), F.col("_removed"))).otherwise(F.col("_row.text")))
    fields = {"text": F.col("_new"), "n_chars": F.when(F.col("_removed").isNotNull(), F.char_length("_new").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return changed.select(*[fields[c].alias(c) if fields.get(c) is not None else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
