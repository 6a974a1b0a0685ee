"""Packing by cutting-stock column generation.

The stock are the document lengths, a pattern is a set of lengths that fills a sequence without padding: its
total is the capacity, or a smaller power of two, which needs none. A linear program over the histogram of
lengths picks patterns that take as many tokens as they can; its columns are priced by a knapsack dynamic
program over the duals. Patterns are rounded to whole sequences of exact lengths and assigned to documents
by their rank among the documents of a length. What no pattern takes is laid out in a row, longest first, and
cut at sequence borders; the last sequence is split into powers of two. So nothing is padded, and only
documents longer than a sequence or outside the patterns are cut.

The driver sees the histogram (at most ``capacity`` rows). The program works on classes of ``GRID``
neighbouring lengths; the exact lengths of a pattern are chosen by a second small dynamic program.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._packed import pack, unpack
from sluice.llm.packing import WordIds, tokenizer_path
from sluice.session import write_table

CAPACITY, END_ID = 4096, 2
#: Tokens of a unit of weight in the knapsack.
UNIT = 4
#: Lengths of a class, the shortest sequence that a pattern may fill, and the tokens that a sequence costs in the program's objective.
GRID, LEAST, OVERHEAD = 16, 256, 32.0
#: Limits of the program: pivots of one run, and runs over what is left.
PIVOTS, RUNS = 4000, 3
#: Pieces that are cut at borders are joined with their ids by broadcast up to this number, by shuffle beyond.
BROADCAST_CUTS = 200_000

#: Words whose ids a worker remembers.
REMEMBERED = 600_000
_ENCODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's encoder: it outlives a task, and what it remembers is bounded."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordIds(path, REMEMBERED)
    return _ENCODERS[path]


_STORED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Token ids of every whole text followed by ``end_id``, in pieces of at most ``capacity`` ids."""
    path = path or tokenizer_path()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = word_ids(path), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(body.as_py()) + end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    values = np.frombuffer(part, "<u4")
                    small = values.astype("<u2") if int(values.max()) < 1 << 16 else values
                    for column, value in zip(out, (key, k // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, pack(small)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(cut, _STORED)


# ---------------------------------------------------------------------------
# the linear program

def totals_of(capacity: int, least: int = LEAST) -> list[int]:
    """Totals that need no padding: the capacity and the powers of two below it, from ``least`` on."""
    return [capacity] + [1 << b for b in reversed(range(capacity.bit_length())) if least <= 1 << b < capacity]


def price(duals: np.ndarray, weights: np.ndarray, goals: list[tuple[int, int]], each: int = 8) -> list[tuple[float, int, np.ndarray]]:
    """Patterns worth most for each goal (total weight, tokens), best first: (gain, tokens, number of each class).

    Knapsack by exact total: cost[u] is the least sum of duals of classes whose weights sum to u. A goal's best
    patterns differ in their first member; a pattern has two members at least.
    """
    most = max(u for u, _ in goals)
    cost, last = np.full(most + 1, np.inf), np.full(most + 1, -1, dtype=np.int64)
    cost[0] = 0.0
    upto = np.searchsorted(weights, np.arange(most + 1), side="right").tolist()
    for u in range(1, most + 1):
        n = upto[u]
        if n:
            c = duals[:n] + cost[u - weights[:n]]
            i = int(c.argmin())
            cost[u], last[u] = c[i], i
    found = []
    for goal, tokens in goals:
        n = int(np.searchsorted(weights, goal, side="left"))  # smaller weights only: not one class alone
        if not n:
            continue
        c = duals[:n] + cost[goal - weights[:n]]
        for i in np.argsort(c, kind="stable")[:each].tolist():
            gain = tokens - OVERHEAD - float(c[i])
            if not np.isfinite(c[i]) or gain <= 1e-6 * tokens:
                break
            column, rest = np.zeros(len(weights)), goal
            while rest:
                column[i] += 1
                rest -= int(weights[i])
                i = int(last[rest]) if rest else -1
            found.append((gain, tokens, column))
    return sorted(found, key=lambda f: -f[0])


def solve(counts: np.ndarray, weights: np.ndarray, goals: list[tuple[int, int]], pivots: int = PIVOTS) -> list[tuple[float, int, np.ndarray]]:
    """Column generation by the revised simplex method: (how often, tokens, number of each class) of the patterns
    in the basis, for: take most tokens, use each class at most ``counts`` times. It starts from no pattern, and
    stopping at ``pivots`` leaves a program that is met, if not best."""
    m = len(counts)
    inverse, x = np.eye(m), counts.astype(np.float64)
    profit, basis = np.zeros(m), [None] * m  # None: what a class leaves
    pool: list[tuple[int, np.ndarray]] = []
    for _ in range(pivots):
        duals = profit @ inverse
        worst = int(duals.argmin())
        best, entering = 1e-7, None
        if duals[worst] < -best:
            best, entering = -float(duals[worst]), (0, None)
        if pool:
            gains = np.array([t - OVERHEAD - float(duals @ c) for t, c in pool])
            at = int(gains.argmax())
            if gains[at] > max(best, 1e-3):
                best, entering = float(gains[at]), pool[at]
        if entering is None or (entering[1] is None and best < 1e-3):
            fresh = price(duals, weights, goals)
            if fresh:
                pool = [*pool, *((t, c) for _, t, c in fresh)][-200:]
                entering = (fresh[0][1], fresh[0][2])
            elif entering is None:
                break
        tokens, column = entering
        if column is None:
            column, gain = np.eye(m)[worst], 0.0
        else:
            gain = tokens - OVERHEAD
        direction = inverse @ column
        positive = direction > 1e-9
        if not positive.any():
            break
        ratio = np.where(positive, x / np.where(positive, direction, 1.0), np.inf)
        out = int(ratio.argmin())
        step = float(ratio[out])
        x = np.maximum(x - step * direction, 0.0)
        x[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        profit[out] = gain
        basis[out] = None if not tokens else (tokens, column)
    return sorted(((float(v), *b) for v, b in zip(x, basis, strict=True) if b is not None and v > 1e-9), key=lambda r: -r[0])


# ---------------------------------------------------------------------------
# rounding to exact lengths

def exact_lengths(classes: list[int], counts: np.ndarray, total: int, grid: int = GRID, free: int = 8) -> list[int] | None:
    """Available lengths, one of each of the given classes (falling), that sum to ``total``; of those found, the ones
    that last longest. Members after the first ``free`` take the commonest length of their class."""
    held = counts.copy()
    chosen, open_ = [], list(classes[:free])
    for k in classes[free:]:
        length = grid * (k - 1) + 1 + int(held[grid * (k - 1) + 1 : grid * k + 1].argmax())
        if held[length] <= 0:
            return None
        held[length] -= 1
        chosen.append(length)
    need = total - sum(chosen) - sum(grid * (k - 1) for k in open_)
    if not len(open_) <= need <= grid * len(open_):
        return None
    value = np.zeros(need + 1)
    value[0] = np.inf
    steps = []
    for i, k in enumerate(open_):
        have = held[grid * (k - 1) + 1 : grid * k + 1] // open_[: i + 1].count(k)  # a length may be taken again
        new, by = np.zeros(need + 1), np.zeros(need + 1, dtype=np.int64)
        for d in range(1, min(grid, need) + 1):
            if have[d - 1] > 0:
                c = np.minimum(value[: need + 1 - d], have[d - 1])
                better = c > new[d:]
                new[d:][better] = c[better]
                by[d:][better] = d
        value = new
        steps.append(by)
    if value[need] <= 0:
        return None
    for k, by in zip(reversed(open_), reversed(steps), strict=True):
        d = int(by[need])
        chosen.append(grid * (k - 1) + d)
        need -= d
    return sorted(chosen, reverse=True)


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID, least: int = LEAST, runs: int = RUNS) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns of exact lengths without padding and how many sequences each fills, and the number of pieces of each
    length that no pattern takes."""
    counts = np.zeros(grid * -(-capacity // grid) + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    found: list[tuple[tuple[int, ...], int]] = []
    if counts[capacity]:
        found.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    totals = totals_of(capacity, least)
    tokens_in = sum(k * n for k, n in histogram.items())
    goals = [(t // UNIT, t) for t in totals]
    lengths_ = np.arange(1, len(counts))
    for _ in range(runs):
        by_class = counts[1:].reshape(-1, grid).sum(1)
        classes = np.flatnonzero(by_class) + 1
        if (counts[1:] * lengths_).sum() <= 0.005 * tokens_in:
            break
        # a class weighs its mean length; the exact lengths make up for the difference
        mean = (counts[1:] * lengths_).reshape(-1, grid).sum(1)[classes - 1] / by_class[classes - 1]
        weights = np.maximum(1, np.rint(mean / UNIT)).astype(np.int64)
        taken = 0
        for often, tokens, column in solve(by_class[classes - 1], weights, goals):
            members = [int(classes[i]) for i in np.flatnonzero(column)[::-1] for _ in range(int(column[i]))]
            want = int(np.ceil(often - 1e-6))
            while want > 0:
                lengths = exact_lengths(members, counts, tokens, grid)
                if lengths is None:
                    break
                need = {x: lengths.count(x) for x in lengths}
                times = min(want, *(int(counts[x]) // k for x, k in need.items()))
                if not times:
                    break
                for x, k in need.items():
                    counts[x] -= times * k
                found.append((tuple(lengths), times))
                want -= times
                taken += times * tokens
        if not taken:
            break
    return found, counts[: capacity + 1]


class Row:
    """The pieces that no pattern takes, in a row from the longest to the shortest, cut at sequence borders: every
    ``capacity`` tokens, and the rest in powers of two."""

    def __init__(self, counts: np.ndarray, capacity: int, first_sequence: int):
        tokens = counts * np.arange(len(counts))
        self.base = np.concatenate([np.cumsum(tokens[::-1])[::-1][1:], [0]])  # tokens of longer pieces
        self.total, self.capacity, self.first = int(tokens.sum()), capacity, first_sequence
        self.full, rest = divmod(self.total, capacity)
        at, tail = self.full * capacity, []
        for b in reversed(range(capacity.bit_length())):
            if rest >> b & 1:
                tail.append(at)
                at += 1 << b
        self.tail = np.array([*tail, self.total + 1], dtype=np.int64)
        self.borders = self.full + len(tail)

    def sequence(self, place: np.ndarray) -> np.ndarray:
        """The sequence, counted from 0, that holds the token at each place."""
        late = self.full + np.searchsorted(self.tail, place, side="right") - 1
        return np.where(place < self.full * self.capacity, place // self.capacity, late)

    def start(self, sequence: np.ndarray) -> np.ndarray:
        """The place of a sequence's first token (of the end, for the one after the last)."""
        sequence = np.asarray(sequence)
        late = np.minimum(self.tail[np.clip(sequence - self.full, 0, len(self.tail) - 1)], self.total)
        return np.where(sequence < self.full, sequence * self.capacity, late)


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Add ``rank`` (from 0) among the pieces of a length. A length with c pieces is spread over about sqrt(c) hash
    buckets; totals of the buckets come first, then a window runs inside one bucket."""
    spark = pieces.sparkSession
    widths = spark.createDataFrame([(k, max(1, int(np.ceil(np.sqrt(n))))) for k, n in histogram.items()], "length long, _buckets long")
    keyed = pieces.join(F.broadcast(widths), "length")  # a row a length: at most ``capacity``
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64("row"), F.col("_buckets"))).drop("_buckets")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("length", "_bucket").orderBy("row")
    return (keyed.join(starts, ["length", "_bucket"]).withColumn("rank", F.col("_start") + F.row_number().over(inside) - 1).drop("_bucket", "_start"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
                   text: str = "text", doc_id: str = "doc_id", grid: int = GRID) -> DataFrame:
    """Pack all documents into sequences of ``capacity`` token ids, or of a power of two, without padding.

    Returns doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian unsigned 32-bit numbers with
    ``keep_ids``, else null), sequence_id and offset: one row per piece. Null and empty texts are one end id;
    repeated rows are separate documents; a null doc_id stays; no rows give none.
    """
    stored = write_table(tokenised(docs, path, capacity, end_id, text, doc_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns, left = plan_patterns(histogram, capacity, grid)
    used = np.zeros(capacity + 1, dtype=np.int64)
    slots: list[tuple[int, int, int, int]] = []
    sequence = 0
    for pattern, times in patterns:
        place = 0
        for length in pattern:
            slots.append((length, int(used[length]), sequence, place))
            used[length] += times
            place += length
        sequence += times
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4).T
    key = table[0] * (1 << 48) + table[1]
    row = Row(left, capacity, sequence)
    numbers = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"]

    def place_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            in_row = rank >= used[length]
            at = np.where(in_row, row.base[length] + (rank - used[length]) * length, 0)
            first, last = row.sequence(at), row.sequence(np.where(in_row, at + length - 1, 0))
            if len(key):
                slot = np.maximum(np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1, 0)
                planned, inside = table[2][slot] + rank - table[1][slot], table[3][slot]
            else:
                planned = inside = np.zeros(len(length), dtype=np.int64)
            where = np.where(in_row, row.first + first, planned)
            offset = np.where(in_row, at - row.start(first), inside)
            extra = [pa.array(where, pa.int64()), pa.array(offset, pa.int64()), pa.array(at, pa.int64()), pa.array(in_row & (first != last))]
            yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in numbers), *extra], names=[*numbers, "sequence_id", "offset", "at", "cut"])

    schema = ", ".join(f"{c} long" for c in [*numbers, "sequence_id", "offset", "at"]) + ", cut boolean"
    placed = write_table(ranked(stored.select(*numbers), histogram).select(*numbers, "rank").mapInArrow(place_, schema), "placed")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            for r in batch.to_pylist():
                ids = unpack(bytes(r["ids"]))[0].astype("<u4")
                spans = [(0, len(ids), r["sequence_id"], r["offset"])]
                if r["cut"]:
                    spans, done = [], 0
                    while done < len(ids):
                        s = int(row.sequence(np.array([r["at"] + done]))[0])
                        stop = min(len(ids), int(row.start(s + 1)) - r["at"])
                        spans.append((done, stop, row.first + s, r["at"] + done - int(row.start(s))))
                        done = stop
                for a, b, s, offset in spans:
                    part = ids[a:b].tobytes()
                    for column, value in zip(out, (r["doc_id"], r["start"] + a, b - a, zlib.crc32(part), r["doc_tokens"], part if keep_ids else None, s, offset), strict=True):
                        column.append(value)
            kinds = [pa.binary() if c == "ids" else pa.int64() for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=columns)

    ids = stored.select("row", "ids")
    whole = placed if keep_ids else placed.where("cut")
    if not keep_ids and row.borders <= BROADCAST_CUTS:  # at most one piece is cut at a border
        whole = F.broadcast(whole)
    kinds = ", ".join("ids binary" if c == "ids" else f"{c} long" for c in columns)
    parts = ids.join(whole, "row").select("doc_id", "start", "doc_tokens", "ids", "sequence_id", "offset", "at", "cut").mapInArrow(split, kinds)
    if keep_ids:
        return parts
    return placed.where("not cut").withColumn("ids", F.lit(None).cast("binary")).select(*columns).unionByName(parts)
