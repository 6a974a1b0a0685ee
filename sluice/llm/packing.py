"""Best-fit packing by exact-complement hashing."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._ranks import running_total
from sluice.session import write_table

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers, and parts of words; beyond it forgets all and starts anew.
REMEMBERED = 250_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A word of Latin letters and marks after them: lower-cased letters and marks are separate parts for the tokenizer.
_LETTERS, _MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), b".,!?;:*#$%&|"
_PROBES = ["the", "Erthing.", "naïve,", "STRASSE!!", "Straße***", "a%%%", "garçon|", "ÉTÉ&&&", "x;:", "y###", "z$$$", "Ÿ", "word"]


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable
    in Latin-1, else the next free one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordIds:
    """Token ids (little-endian unsigned 32-bit) of whole texts, word by word.

    The tokenizer splits at white space before anything else, so a text's ids are its words' ids in a
    row. Each distinct word is encoded once and remembered. A word of letters and marks is the ids of the
    two parts, which skips the tokenizer's normaliser; that way is taken only if it agrees with the whole
    tokenizer on probe words.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered, self.known, self.parts = Tokenizer.from_file(path), remembered, {}, {}
        self.model, self.alphabet = self.tokenizer.model, _byte_characters()
        self.short = all(self._split(w.encode()) in (None, x) for w, x in zip(_PROBES, self._whole(_PROBES), strict=True))

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(c.ids, dtype="<u4").tobytes() for c in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _split(self, word: bytes) -> bytes | None:
        """Ids of a word of letters and marks; None for other words."""
        stem = word.rstrip(_MARKS)
        if stem.isalpha():  # ASCII
            low = stem.lower()
        else:
            text = stem.decode("utf-8", "replace")
            if not _LETTERS.fullmatch(text):
                return None
            low = text.lower().encode()
        ids = self.parts.get(low) or self._part(low)
        if len(stem) == len(word):
            return ids
        marks = word[len(stem) :]
        return ids + (self.parts.get(marks) or self._part(marks))

    def _part(self, part: bytes) -> bytes:
        coded = part.decode() if part.isascii() else "".join([self.alphabet[b] for b in part])
        found = [t.id for t in self.model.tokenize(coded)]
        ids = self.parts[part] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def __call__(self, text: bytes | None) -> bytes:
        words = (text or b"").split()
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > self.remembered:
            known.clear()
            new = set(words)
        if len(self.parts) > self.remembered:
            self.parts.clear()
        rest = []
        for w in new:
            ids = self._split(w) if self.short else None
            if ids is None:
                rest.append(w)
            else:
                known[w] = ids
        if rest:
            known.update(zip(rest, self._whole([w.decode("utf-8", "replace") for w in rest]), strict=True))
        return b"".join([known[w] for w in words])


_KEPT: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's encoder: it outlives a task, and what it remembers is bounded."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = WordIds(path)
    return _KEPT[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False,
               text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Token ids of every whole text followed by ``end_id``, cut into pieces of ``capacity`` ids.

    A null text is empty: one piece with the end id. ``ids`` is null unless ``keep_ids``.
    """
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = word_ids(path), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            out = [[], [], [], [], [], []]
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(body.as_py()) + end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    for column, value in zip(out, (key, k // width, k // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(cut, PIECES)


class SumIndex:
    """Sums below ``capacity`` of one, two and three of the lengths in ``counts``, indexed once.

    A pair is kept under its sum, a triple under its sum as a length and the sum of a pair; larger lengths come
    first. ``use`` lowers the counts. Counts only fall, so a pair without its lengths is passed by for good: every
    sum remembers its first pair that is still there.
    """

    def __init__(self, counts: np.ndarray, capacity: int):
        self.counts: list[int] = counts.tolist()
        have = np.flatnonzero(counts[:capacity]).astype(np.int32)
        pairs, starts = self._by_sum(have, have, capacity, ordered=True)
        self.larger, self.smaller, self.starts = memoryview(pairs[0]), memoryview(pairs[1]), starts.tolist()
        self.first = self.starts[:-1]
        sums = np.flatnonzero(np.diff(starts)).astype(np.int32)
        triples, starts = self._by_sum(have, sums, capacity)
        self.single, self.pair_sum, self.triple_starts = memoryview(triples[0]), memoryview(triples[1]), starts.tolist()

    @staticmethod
    def _by_sum(a: np.ndarray, b: np.ndarray, capacity: int, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All (x, y) of ``a`` and ``b`` with a sum below ``capacity``, by sum and falling x (``ordered``: y at most
        x), and where each sum starts."""
        fits = a[:, None] + b[None, :] < capacity
        if ordered:
            fits &= b[None, :] <= a[:, None]
        i, j = np.nonzero(fits)
        x, y = a[i], b[j]
        by = np.lexsort((-x, x + y))
        x, y = x[by], y[by]
        return np.stack([x, y]), np.searchsorted(x + y, np.arange(capacity + 1))

    def _there(self, at: int) -> bool:
        a, b = self.larger[at], self.smaller[at]
        return self.counts[a] > (a == b) and self.counts[b] > 0

    def singles(self, total: int) -> Iterator[tuple[int, ...]]:
        if self.counts[total]:
            yield (total,)

    def pairs(self, total: int) -> Iterator[tuple[int, ...]]:
        at, end = self.first[total], self.starts[total + 1]
        while at < end and not self._there(at):
            at += 1
        self.first[total] = at
        for k in range(at, end):
            if self._there(k):
                yield self.larger[k], self.smaller[k]

    def triples(self, total: int) -> Iterator[tuple[int, ...]]:
        for k in range(self.triple_starts[total], self.triple_starts[total + 1]):
            a = self.single[k]
            if self.counts[a]:
                for b, c in self.pairs(self.pair_sum[k]):
                    if not self.counts[a]:
                        break
                    yield a, b, c

    def use(self, pattern: tuple[int, ...]) -> int:
        """Take ``pattern`` as often as its lengths last."""
        need = {x: pattern.count(x) for x in pattern}
        times = min(self.counts[x] // k for x, k in need.items())
        if times:
            for x, k in need.items():
                self.counts[x] -= times * k
        return times


def _exact(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that fill ``capacity`` exactly, with how often; lowers ``counts``.

    From the longest length down, the gap is looked up in the index of single lengths, sums of pairs and sums of
    triples, larger members first; a combination is used as often as its members last.
    """
    index = SumIndex(counts, capacity)
    found: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        gap = capacity - length
        for fillers in (index.singles, index.pairs, index.triples) if gap else (lambda _: iter([()]),):
            if not index.counts[length]:
                break
            for members in fillers(gap):
                times = index.use((length, *members))
                if times:
                    found.append(((length, *members), times))
                if not index.counts[length]:
                    break
    counts[:] = index.counts
    return found


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing of what is left, in bulk: equal lengths enter equal open sequences together."""
    gaps: list[int] = []
    open_: dict[int, dict[tuple[int, ...], int]] = {}

    def put(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if gap not in open_:
            open_[gap] = {}
            insort(gaps, gap)
        open_[gap][pattern] = open_[gap].get(pattern, 0) + times

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                per = capacity // length
                if n >= per:
                    put(capacity - per * length, (length,) * per, n // per)
                if n % per:
                    put(capacity - (n % per) * length, (length,) * (n % per), 1)
                break
            gap = gaps[at]
            pattern, times = next(iter(open_[gap].items()))
            m = min(n, times)
            if m == times:
                del open_[gap][pattern]
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            else:
                open_[gap][pattern] = times - m
            put(gap - length, (*pattern, length), m)
            n -= m
        counts[length] = 0
    return [x for g in gaps for x in open_[g].items()]


def plan_patterns(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of piece lengths and how many sequences each fills, for ``lengths`` (length: count)."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in lengths.items():
        counts[length] = n
    return _exact(counts, capacity) + _best_fit(counts, capacity)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces.

    The driver sees the histogram of lengths only (at most ``capacity`` rows); every slot of the planned
    patterns is a run of ranks of one length, and each piece finds its slot by its rank among the pieces
    of its length. Ranks come from running totals spread over hash buckets, so a length shared by a
    third of all pieces is no hot group.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = dict.fromkeys(histogram, 0)
    lengths, firsts, bases, offsets, sequence = [], [], [], [], 0
    for pattern, times in plan_patterns(histogram, capacity):
        place = 0
        for length in pattern:
            lengths.append(length)
            firsts.append(at[length])
            bases.append(sequence)
            offsets.append(place)
            at[length] += times
            place += length
        sequence += times
    slots = np.array([lengths, firsts, bases, offsets], dtype=np.int64).reshape(4, -1)
    slots = slots[:, np.lexsort((slots[1], slots[0]))]
    key = slots[0] * (1 << 48) + slots[1]
    ranked = running_total(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], F.lit(1), "_rank")
    columns = pieces.columns
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = t["length"].to_numpy(), t["_rank"].to_numpy() - 1
            slot = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            arrays = [t[c].combine_chunks() for c in columns] + [pa.array(slots[2][slot] + rank - slots[1][slot], pa.int64()), pa.array(slots[3][slot], pa.int64())]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else a.combine_chunks() for a in arrays], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place_, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False,
                   text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` token ids.

    Returns doc_id, piece, start, length, ids_crc32, ids (the ids as little-endian unsigned 32-bit
    numbers with ``keep_ids``, else null), sequence_id and offset: one row per piece. Null and empty
    texts are one end id; repeated rows are separate documents; a null doc_id stays; no rows give none.
    """
    return pack_pieces(write_table(cut_pieces(docs, path, capacity, end_id, keep_ids, text, doc_id), "pieces"), capacity)
