"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets with ``overlap >= t`` share at least L tokens of their prefixes of ``size - t + L`` tokens, in
any fixed order of tokens; here the rarest come first. Every document picks its own L: a longer prefix
costs more postings but asks for more shared tokens, so fewer candidates need verification. A pair has to
share ``min(L, L')`` tokens.

1. Shingle hashes are counted by bounded summaries. Those above a bound are hot: their number is known from here,
   so they go straight to the classes that hold them.
   The others are dealt by hash range; equal sets travel once (class = hash of the set). A task
   drops the shingles of one class only and tells the others' number of classes.
2. By class, the shared shingles are put in order. A class with too many unshared shingles has an empty
   prefix, so it cannot have a partner, and ends here.
3. Classes that share a prefix shingle form clusters (their connected components).
   Candidates exist inside clusters only.
4. Small clusters are joined many at a time, large ones block by block; a task emits at most one link
   per class (a spanning forest), never all pairs of a group.
5. Links and equal sets give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._packed import pack, runs, unpack
from sluice.llm._text import U64, Words, blocks, mix64, release, table_bytes, windows
from sluice.llm.graph import connected_components, roots_of, shared_token_edges
from sluice.session import write_table

WIDTH, PERCENT = 4, 85
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
#: A shingle is hot when it has this many entries, or this share of all entries if that is more.
HOT, HOT_SHARE = 1 << 16, 2.0**-19
#: Shared shingles that one join task holds, about; larger clusters are split in blocks.
JOIN_TOKENS = 1_000_000
#: Costs in units of one posting: a prefix token looked up, a candidate verified.
LOOKUP, VERIFY = 60.0, 3000.0


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside a text, and the borders of the texts. A text of
    fewer words is one shingle, its whole sequence; without words it has none."""
    words = Words(texts, lower=True)
    hashes, n = words.hashes(), words.lengths()
    rolled, text, _ = windows(hashes, words.offsets, width)
    border = np.searchsorted(text, np.arange(len(texts) + 1))
    sets = []
    for i in range(len(texts)):
        if n[i] >= width:
            s = np.sort(rolled[border[i] : border[i + 1]])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n[i]:
            at = words.offsets[i]
            short, _, _ = windows(hashes[at : at + n[i]], np.array([0, n[i]]), int(n[i]))
            sets.append(mix64(short + U64(int(n[i]))))
        else:
            sets.append(np.empty(0, U64))
    return np.concatenate(sets) if sets else np.empty(0, U64), np.cumsum([0] + [len(s) for s in sets])


def _class_of(tokens: np.ndarray, border: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set (order-free): equal sets are one class."""
    total = np.concatenate([[U64(0)], np.cumsum(mix64(tokens ^ U64(0xD6E8FEB86659FD93)))]).astype(U64)
    return mix64(total[border[1:]] - total[border[:-1]] + np.diff(border).astype(U64)).view(np.int64)


def prefix_length(n: np.ndarray | int, level: np.ndarray | int, percent: int):
    """Tokens of a set of ``n`` in its prefix for ``level`` matches."""
    return n + (-percent * n) // 100 + level  # n - ceil(percent * n / 100) + level


def _entries(texts: list[bytes | None], width: int) -> tuple[np.ndarray, ...]:
    """Of a block: set sizes and classes of the texts, the first text of each class that has shingles, and the shingles
    of those texts, each with its text."""
    tokens, border = shingle_sets(texts, width)
    n = np.diff(border)
    kind = _class_of(tokens, border)
    _, first = np.unique(kind, return_index=True)
    first = first[n[first] > 0]
    keep = np.zeros(len(n), dtype=bool)
    keep[first] = True
    text = np.repeat(np.arange(len(n), dtype=np.uint32), n)
    chosen = keep[text]
    return n, kind, first, tokens[chosen], text[chosen]


class Summary:
    """Counts of the most frequent tokens of a stream in at most ``size`` counters: a count is too small by at most
    ``seen / size``, and a token that is more frequent than that has a counter."""

    def __init__(self, size: int):
        self.size, self.seen = size, 0
        self.tokens, self.counts = np.empty(0, U64), np.empty(0, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        self.seen += len(tokens)
        new, counts = np.unique(tokens, return_counts=True)
        self.tokens, where = np.unique(np.concatenate([self.tokens, new]), return_inverse=True)
        self.counts = np.bincount(where, weights=np.concatenate([self.counts, counts]), minlength=len(self.tokens)).astype(np.int64)
        if len(self.tokens) > self.size:
            self.counts -= np.partition(self.counts, len(self.counts) - self.size - 1)[len(self.counts) - self.size - 1]
            stay = self.counts > 0
            self.tokens, self.counts = self.tokens[stay], self.counts[stay]


def frequent(plain: DataFrame, width: int, text_bytes: int, hot: int = HOT, hot_share: float = HOT_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """The hot shingles, sorted, and their counted numbers of entries (one of a class and block).

    Every shingle with ``hot`` entries and the share ``hot_share`` of all entries is found, and none below a quarter
    of the two; there are at most 4 / ``hot_share``. Tasks count in bounded summaries and send what may be frequent.
    """
    share = max(hot_share, min(hot / max(text_bytes, 1), 1.0))  # a text has fewer entries than bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(int(np.ceil(4 / share)))
        for block in blocks(batches, "text", BLOCK_BYTES):
            summary.add(_entries(block["text"], width)[3])
        release()
        often = summary.counts >= max(share / 4 * summary.seen, 1)
        token = pa.array([None, *summary.tokens[often].view(np.int64).tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([token, pa.array([summary.seen, *summary.counts[often].tolist()], pa.int64())], names=["token", "entries"])

    counted = write_table(plain.select("text").mapInArrow(count, "token long, entries long").groupBy("token").agg(F.sum("entries").alias("entries")), "frequent")
    total = counted.where("token is null").agg(F.max("entries")).first()[0] or 0
    rows = counted.where(F.col("token").isNotNull() & (F.col("entries") >= F.lit(share / 4 * total))).collect()
    found = sorted((r["token"] % (1 << 64), r["entries"]) for r in rows)
    return np.array([t for t, _ in found], dtype=U64), np.array([c for _, c in found], dtype=np.int64)


def _deal(block: dict[str, list], width: int, buckets: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A block's documents, its classes with their sizes and hot shingles (by class) and the other shingles of the
    classes (by hash range)."""
    n, kind, first, tokens, text = _entries(block["text"], width)
    ids = np.array([x if x is not None else 0 for x in block["doc_id"]], dtype=np.int64)
    null = np.array([x is None for x in block["doc_id"]], dtype=np.uint8)
    yield 2 * buckets + int(mix64(kind[:1].view(U64) + ids[:1].view(U64))[0] % U64(buckets)), pack(kind, n.astype(np.uint32), ids, null)
    if not len(first):
        return
    is_hot = np.zeros(len(tokens), dtype=bool)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
    hot_tokens, hot_text = tokens[is_hot], text[is_hot]
    tokens, text = tokens[~is_hot], text[~is_hot]
    target = kind[first].view(U64) % U64(buckets)
    by = np.argsort(target, kind="stable")
    first = first[by]
    for i, j in _spans(target[by]):
        some = first[i:j]
        low, high = np.searchsorted(hot_text, some), np.searchsorted(hot_text, some, side="right")
        held = np.concatenate([hot_tokens[a:b] for a, b in zip(low, high, strict=True)])
        yield buckets + int(target[by[i]]), pack(np.zeros(1, np.uint8), kind[some], n[some].astype(np.uint32), (high - low).astype(np.uint32), held)
    by = np.argsort(tokens)
    tokens, text = tokens[by], text[by]
    bucket = ((tokens >> U64(32)) * U64(buckets)) >> U64(32)
    for i, j in _spans(bucket):
        present, inverse = np.unique(text[i:j], return_inverse=True)
        yield int(bucket[i]), pack(tokens[i:j], kind[present], inverse.astype(np.uint32))


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    border = runs(keys)
    return list(zip(border[:-1].tolist(), border[1:].tolist(), strict=True))


def _share(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """One range of shingles: those of two or more classes, with that number, by class."""
    release()
    if int(frame["bucket"].iloc[0]) >= buckets:
        return frame
    tokens, present, places, held = [], [], [], 0
    for value in frame["packed"]:
        t, kinds, inverse = unpack(value)
        tokens.append(t)
        present.append(kinds)
        places.append(inverse + np.uint32(held))
        held += len(kinds)
    token, place, kinds = np.concatenate(tokens), np.concatenate(places), np.concatenate(present)
    del tokens, present, places
    by = np.argsort(token)
    token = token[by]
    twin = np.zeros(len(token), dtype=bool)
    equal = token[1:] == token[:-1]
    twin[1:] |= equal
    twin[:-1] |= equal
    token, kind = token[twin], kinds[place[by[twin]]]
    del by, place
    by = np.lexsort((kind, token))
    token, kind = token[by], kind[by]
    new = np.ones(len(token), dtype=bool)  # one entry for a class, whatever the blocks it came in
    new[1:] = (token[1:] != token[:-1]) | (kind[1:] != kind[:-1])
    token, kind = token[new], kind[new]
    border = runs(token)
    often = np.repeat(np.diff(border), np.diff(border)).astype(np.uint32)
    token, kind, often = token[often > 1], kind[often > 1], often[often > 1]
    target = kind.view(U64) % U64(buckets)
    by = np.lexsort((token, kind, target))
    token, kind, often, target = token[by], kind[by], often[by], target[by]
    out = []
    for i, j in _spans(target):
        part = runs(kind[i:j])
        out.append((buckets + int(target[i]), pack(np.ones(1, np.uint8), kind[i:j][part[:-1]], np.diff(part).astype(np.uint32), token[i:j], often[i:j])))
    return pd.DataFrame(out, columns=["bucket", "packed"])


def _order(frame: pd.DataFrame, percent: int, buckets: int, hot: np.ndarray, hot_often: np.ndarray) -> pd.DataFrame:
    """By class, where the prefix is not empty, its shared and hot shingles, rarest first. Documents pass as they came."""
    columns = ["kind", "n", "tokens", "often"]
    if int(frame["bucket"].iloc[0]) >= 2 * buckets:
        return pd.DataFrame([(None, 0, value, None) for value in frame["packed"]], columns=columns).astype({"kind": "Int64"})
    sizes, entries = [], []
    for value in frame["packed"]:
        mark, *rest = unpack(value)
        (entries if mark[0] else sizes).append(rest)
    rows = []
    size_of: dict[int, int] = {}
    for kind, n, many, held in sizes:
        size_of.update(zip(kind.tolist(), n.tolist(), strict=True))
        if len(held):
            entries.append([kind, many, held, np.minimum(hot_often[np.searchsorted(hot, held)], (1 << 32) - 1).astype(np.uint32)])
    if entries:
        which = np.concatenate([np.repeat(e[0], e[1]) for e in entries])
        token, often = (np.concatenate([e[i] for e in entries]) for i in (2, 3))
        by = np.lexsort((token, often, which))
        which, token, often = which[by], token[by], often[by]
        new = np.ones(len(which), dtype=bool)  # the hot shingles of a class come from every block that it is in
        new[1:] = (which[1:] != which[:-1]) | (token[1:] != token[:-1])
        which, token, often = which[new], token[new], often[new]
        for i, j in _spans(which):
            k = int(which[i])
            total = size_of[k]
            if total - (j - i) < prefix_length(total, 1, percent):
                rows.append((k, total, token[i:j].tobytes(), often[i:j].tobytes()))
    return pd.DataFrame(rows, columns=columns).astype({"kind": "Int64"})


def _prefix_members(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(class, shingle) for the shared shingles of every prefix that asks for one match; classes of one batch
    that share a shingle are linked at once (class, class, true), and one of them keeps it: a hot shingle
    sends one row a batch."""
    for batch in batches:
        node, token = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for kind, n, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            t = np.frombuffer(tokens, np.int64)
            t = t[: prefix_length(n, 1, percent) - (n - len(t))]
            node.append(np.full(len(t), kind, dtype=np.int64))
            token.append(t)
        node, token = np.concatenate(node), np.concatenate(token)
        by = np.argsort(token, kind="stable")
        node, token = node[by], token[by]
        again = np.concatenate([[False], token[1:] == token[:-1]]) if len(token) else np.empty(0, bool)
        at = np.flatnonzero(again)
        a, root = roots_of(node[at], node[at - 1])
        a, root = a[a != root], root[a != root]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, node[~again]])), pa.array(np.concatenate([root, token[~again]])),
                                          pa.array(np.arange(len(a) + int((~again).sum())) < len(a))], names=["a", "b", "linked"])


def choose_level(n: int, often: np.ndarray, percent: int) -> tuple[int, int]:
    """(matches asked for, shared shingles in the prefix) of least estimated cost.

    A prefix of k shared shingles reads the postings of all of them and leaves at most postings / level
    candidates to verify. Levels are 1, 2, 4 ... and the whole set.
    """
    alone = n - len(often)
    reads = np.concatenate([[0], np.cumsum(often, dtype=np.float64)])
    most = -((-percent * n) // 100)
    best = None
    level = 1
    while True:
        k = min(max(prefix_length(n, level, percent) - alone, 0), len(often))
        cost = LOOKUP * k + reads[k] + VERIFY * reads[k] / level
        if best is None or cost < best[0]:
            best = (cost, level, int(k))
        if level >= most:
            return best[1], best[2]
        level = min(2 * level, most)


def link_block(kinds: list[int], sizes: list[int], tokens: list[np.ndarray], often: list[np.ndarray], sides: list[int],
               two_sided: bool, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that span the components of the given classes (with ``two_sided``: of the links between sides).

    Exact: every pair that shares enough prefix shingles is verified unless the two are connected already.
    """
    m = len(kinds)
    level, length = zip(*(choose_level(n, f, percent) for n, f in zip(sizes, often, strict=True)), strict=True)
    level, size, side = np.array(level), np.array(sizes, dtype=np.int64), np.array(sides)
    whole = np.array([k == len(t) for k, t in zip(length, tokens, strict=True)])
    flat = np.concatenate([t[:k] for t, k in zip(tokens, length, strict=True)])
    owner = np.repeat(np.arange(m), length)
    distinct, inverse = np.unique(flat, return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    postings, begin = owner[by], np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(distinct)))]).tolist()
    seen = [0] * len(distinct)
    own = np.concatenate([[0], np.cumsum(length)])
    group = np.arange(m)
    sets: dict[int, frozenset] = {}

    def as_set(i: int) -> frozenset:
        if i not in sets:
            sets[i] = frozenset(tokens[i].tolist())
        return sets[i]

    links = []
    for a in range(m):
        mine = inverse[own[a] : own[a + 1]].tolist()
        lists = [postings[begin[t] : begin[t] + seen[t]] for t in mine if seen[t]]
        for t in mine:
            seen[t] += 1
        if not lists:
            continue
        found = np.concatenate(lists)
        if len(found) * 8 < m:
            other, shared = np.unique(found, return_counts=True)
        else:
            shared = np.bincount(found)
            other = np.flatnonzero(shared)
            shared = shared[other]
        small, large = np.minimum(size[other], size[a]), np.maximum(size[other], size[a])
        keep = (100 * small >= percent * large) & (shared >= np.minimum(level[other], level[a])) & (group[other] != group[a])
        if two_sided:
            keep &= side[other] != side[a]
        other, shared = other[keep], shared[keep]
        for b, s in sorted(zip(other.tolist(), shared.tolist(), strict=True), key=lambda x: -x[1]):
            if group[b] == group[a]:
                continue
            if not (whole[a] and whole[b]):
                s = len(as_set(a) & as_set(b))
            if 100 * s >= percent * (size[a] + size[b] - s):
                links.append((kinds[a], kinds[b]))
                group[group == group[b]] = group[a]
    return links


def _join(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    release()
    frame = frame.sort_values(["n", "kind"])
    links = link_block(frame["kind"].tolist(), frame["n"].tolist(), [np.frombuffer(t, U64) for t in frame["tokens"]],
                       [np.frombuffer(t, np.uint32) for t in frame["often"]], frame["side"].tolist(), frame["side"].nunique() > 1, percent)
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def _links(classes: DataFrame, percent: int, join_tokens: int) -> DataFrame:
    """Spanning links between classes (columns a, b)."""
    members = classes.select("kind", "n", "tokens").mapInArrow(lambda it: _prefix_members(it, percent), "a long, b long, linked boolean")
    cluster = connected_components(shared_token_edges(members))
    clusters = classes.select("kind", (F.octet_length("tokens") / 8).cast("long").alias("held")).join(
        cluster, F.col("kind") == F.col("node"), "left").select("kind", "held", F.coalesce("root", "kind").alias("cluster"))
    clusters = write_table(clusters, "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("held").alias("total")).where("members > 1")
    total = sizes.agg(F.sum("total")).first()[0] or 0
    tasks = 1 + int(total) // join_tokens
    placed = (clusters.join(sizes, "cluster").withColumn("parts", F.ceil(F.col("total") / join_tokens).cast("int"))
              .withColumn("part", F.pmod(F.xxhash64("kind"), F.col("parts")).cast("int")).select("kind", "cluster", "parts", "part"))
    members = write_table(classes.join(placed, "kind"), "members")
    small = members.where("parts = 1").select(F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("cluster"), F.lit(-1).alias("i"), F.lit(-1).alias("j"),
                                              "kind", "n", "tokens", "often", F.lit(0).alias("side"))
    large = members.where("parts > 1")

    def join(groups: DataFrame) -> DataFrame:
        return groups.groupBy("cluster", "i", "j").applyInPandas(lambda f: _join(f, percent), "a long, b long")

    # blocks with themselves and with block 0: a tight cluster is one component after this
    column = ["kind", "n", "tokens", "often", F.col("part").alias("side")]
    first = (large.withColumn("_at", F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0), F.lit(-1))))
             .withColumn("_at", F.explode("_at"))
             .select("cluster", F.when(F.col("_at") < 0, F.col("part")).otherwise(F.lit(0)).alias("i"),
                     F.when(F.col("part") == 0, F.col("_at")).otherwise(F.col("part")).alias("j"), *column))
    links = write_table(join(small.union(first)), "links")
    if large.isEmpty():
        return links
    # the rest: classes outside their cluster's largest component meet every block they have not met
    joined = connected_components(links)
    state = large.join(joined, large["kind"] == joined["node"], "left").select("cluster", "parts", "part", "kind", "n", "tokens", "often", F.coalesce("root", "kind").alias("root"))
    state = write_table(state, "state")
    top = state.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max_by("root", F.struct("c", "root")).alias("giant"))
    loose = state.join(top, "cluster").where("root <> giant")
    homes = loose.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("tokens") / 8) / join_tokens).cast("int").alias("homes"))
    loose = (loose.join(homes, "cluster").withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("cluster", F.pmod(F.xxhash64("kind"), F.col("homes")).cast("int").alias("i"), F.col("_at").alias("j"), "kind", "n", "tokens", "often", F.lit(0).alias("side")))
    others = (state.join(homes, "cluster").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)))
              .select("cluster", "i", F.col("part").alias("j"), "kind", "n", "tokens", "often", F.lit(1).alias("side")))
    rest = write_table(join(loose.union(others)), "links")
    return links.union(rest)


def deal(plain: DataFrame, width: int, buckets: int, common: Broadcast) -> DataFrame:
    """(bucket, packed): shingles in buckets below ``buckets``, sizes and hot shingles of classes in as many more, documents above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            for key, value in _deal(block, width, buckets, common.value[0]):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([value], pa.binary())], names=["bucket", "packed"])
        release()

    return plain.mapInArrow(run, "bucket long, packed binary")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id",
                    join_tokens: int = JOIN_TOKENS, hot: int = HOT) -> DataFrame:
    """Components of documents linked by ``100 * intersection >= percent * union`` of their sets of
    distinct ``width``-word shingles (lower-cased A-Z).

    Returns doc_id, n_shingles, class_id (equal sets) and component_id, the smallest doc_id reachable by
    links, itself included; one row per input row. Null texts and texts without words have an empty set
    and no link. A null doc_id takes part but is never a component's id unless all its doc_ids are null.
    """
    text_bytes = table_bytes(docs.sparkSession, docs, [text])
    buckets = 1 + text_bytes // BUCKET_BYTES
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(frequent(plain, width, text_bytes, hot))  # at most 4 / HOT_SHARE shingles
    dealt = deal(plain, width, buckets, common)
    shared = dealt.groupBy("bucket").applyInPandas(lambda f: _share(f, buckets), "bucket long, packed binary")
    ordered = write_table(shared.groupBy("bucket").applyInPandas(lambda f: _order(f, percent, buckets, *common.value), "kind long, n long, tokens binary, often binary"), "classes")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                kind, n, ids, null = unpack(value)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(n.astype(np.int64)), pa.array(kind)],
                                                 names=["doc_id", "n_shingles", "class_id"])

    rows = ordered.where("kind is null").select("tokens").mapInArrow(unfold, "doc_id long, n_shingles long, class_id long")
    links = _links(ordered.where("kind is not null"), percent, join_tokens)
    component = connected_components(links)
    full = rows.where("n_shingles > 0")
    classes = (full.groupBy("class_id").agg(F.min("doc_id").alias("_least"))
               .join(component, F.col("class_id") == F.col("node"), "left")
               .select("class_id", "_least", F.coalesce("root", "class_id").alias("_root")))
    least = classes.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = classes.join(least, "_root").select(F.col("class_id").alias("_class"), "component_id")
    return (rows.join(named, (F.col("class_id") == F.col("_class")) & (F.col("n_shingles") > 0), "left")
            .select("doc_id", "n_shingles", "class_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near duplicates: of each component the document with the smallest doc_id stays (all
    rows of that doc_id: they are one document); documents without words are linked with nothing and stay."""
    found = near_duplicates(docs, **options).select(F.col("doc_id").alias("_k"), F.col("component_id").alias("_c"), "n_shingles").where("n_shingles > 0")
    drop = found.where(~F.col("_k").eqNullSafe(F.col("_c"))).select("_k").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), F.struct("*").alias("_row"))
    kept = rows.join(drop, F.col("_d").eqNullSafe(F.col("_k")), "left_anti")
    return kept.select("_row.*")
