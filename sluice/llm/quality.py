"""Quality rules: hashed n-gram log-likelihood ratio of trusted texts against the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._packed import pack, unpack
from sluice.llm._text import U64, Words, blocks, mix64, windows
from sluice.operators.sequence import slice_count, sliced
from sluice.session import write_table

#: Hash buckets of the two multinomials over one- and two-word grams, and slices they are summed in.
BUCKETS, SLICES = 1 << 18, 64
#: The threshold passes at least this share of the trusted texts it is set on.
PASSED = 0.995
#: Added to each bucket's count, as a share of the mean count.
SMOOTHING = 0.1
BLOCK_BYTES = 4 << 20
MIN_WORDS, REPEAT_PERCENT, REPEAT_WIDTH = 50, 50, 3
SYMBOLS = b"#*$%&|<>"


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and the buckets and texts of all one- and two-word grams."""
    hashes = words.hashes()
    text = np.repeat(np.arange(len(words.offsets) - 1), words.lengths())
    pairs, pair_text, _ = windows(hashes, words.offsets, 2)
    bucket = np.concatenate([mix64(hashes + U64(1)), pairs]) & U64(BUCKETS - 1)
    return hashes, bucket.astype(np.int64), np.concatenate([text, pair_text])


def gram_counts(docs: DataFrame, text: str = "text", trusted: str = "trusted") -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket of the raw corpus (all rows) and of the rows where ``trusted`` is true.

    A task sends one row a slice, summed first in groups of 64 tasks, then altogether; the driver
    receives two numbers a bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for block in blocks(batches, "text", BLOCK_BYTES):
            _, bucket, owner = _grams(Words(block["text"]))
            raw += np.bincount(bucket, minlength=BUCKETS)
            chosen = np.array(block["trusted"], dtype=bool)
            if chosen.any():
                target += np.bincount(bucket[chosen[owner]], minlength=BUCKETS)
        context = TaskContext.get()
        group = (context.partitionId() if context else 0) // 64
        width = BUCKETS // SLICES
        for i in range(SLICES):
            at = slice(i * width, (i + 1) * width)
            if raw[at].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([group], pa.int32()), pa.array([pack(raw[at], target[at])], pa.binary())], names=["part", "grp", "packed"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for value in frame["packed"]:
            columns = unpack(value)
            total = columns if total is None else [a + b for a, b in zip(total, columns, strict=True)]
        return pd.DataFrame([(int(frame["part"].iloc[0]), int(frame["grp"].iloc[0]), pack(*total))], columns=["part", "grp", "packed"])

    schema = "part int, grp int, packed binary"
    plain = docs.select(F.col(text).cast("binary").alias("text"), F.coalesce(F.col(trusted), F.lit(False)).alias("trusted"))
    sums = plain.mapInArrow(count, schema).groupBy("part", "grp").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema).collect()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    width = BUCKETS // SLICES
    for row in sums:
        raw[row["part"] * width : (row["part"] + 1) * width], target[row["part"] * width : (row["part"] + 1) * width] = unpack(bytes(row["packed"]))
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log of target probability over raw probability by bucket; zeros if one side has no gram."""
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw), np.float32)
    p, q = target / target.sum(), raw / raw.sum()
    floor = smoothing / len(raw)
    return np.log((p + floor) / (q + floor)).astype(np.float32)


def _of_texts(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of per-byte or per-word flags over the texts' ranges."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            again += line in seen
            seen.add(line)
    return again


def measure(texts: list[bytes | None], ratios: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts and the mean log ratio of each text."""
    words = Words(texts)
    hashes, bucket, owner = _grams(words)
    n = words.lengths()
    at = words.text_at
    char = ~_BLANK[words.buf] & ((words.buf & 0xC0) != 0x80)
    rolled, text, start = windows(hashes, words.offsets, REPEAT_WIDTH)
    key = mix64(rolled ^ mix64(text.astype(U64)))
    by = np.argsort(key)
    same = key[by][1:] == key[by][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    first = words.offsets[text[twice]] + start[twice]
    np.add.at(cover, first, 1)
    np.add.at(cover, first + REPEAT_WIDTH, -1)
    grams = np.bincount(owner, minlength=len(texts))
    return {
        "n_words": n.astype(np.int64),
        "word_chars": _of_texts(char, at),
        "n_symbols": _of_texts(_SYMBOL[words.buf], at),
        "n_dup_lines": np.array([repeated_lines(t) if t else 0 for t in texts], dtype=np.int64),
        "n_repeat_words": _of_texts(np.cumsum(cover[:-1]) > 0, words.offsets),
        "llr": np.bincount(owner, weights=ratios[bucket], minlength=len(texts)) / np.maximum(grams, 1),
    }


def score(docs: DataFrame, ratios: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, the base counts and llr, the mean log ratio of its grams (0 without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS 4-byte numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            found = measure(block["text"], shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(block["doc_id"], pa.int64()), *[pa.array(v) for v in found.values()]], names=["doc_id", *found])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double")


def choose_threshold(good: np.ndarray, bad: np.ndarray, passed: float = PASSED) -> float:
    """The threshold with the largest (good passed - bad passed) among those that pass at least the share
    ``passed`` of the good scores; without good scores minus infinity."""
    if not len(good):
        return float("-inf")
    good, bad = np.sort(good), np.sort(bad)
    most = good[int((1 - passed) * len(good))]
    if not len(bad):
        return float(most)
    at = np.unique(np.concatenate([good[good <= most], bad[bad < most]]))
    at = np.concatenate([at, (at[1:] + at[:-1]) / 2])
    gain = (len(good) - np.searchsorted(good, at)) / len(good) - (len(bad) - np.searchsorted(bad, at)) / len(bad)
    best = at[gain >= gain.max() - 1e-12]
    return float(best.min())


def threshold_of(scores: DataFrame, passed: float = PASSED, num_partitions: int | None = None) -> float:
    """``choose_threshold`` of a table: ``scores`` has llr, good and bad (numbers of labelled texts with that score).

    Scores are cut into ranges; a range's running totals begin where the ones before it end. The driver
    sees a few numbers.
    """
    values = scores.groupBy("llr").agg(F.sum("good").cast("long").alias("good"), F.sum("bad").cast("long").alias("bad"))
    values = write_table(values, "scores")
    n = values.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()  # one row
    if not n.good:
        return float("-inf")
    r = sliced(values, [], ["llr"], slice_count(values, num_partitions))
    ranges = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = (r.groupBy("_pid").agg(F.sum("good").alias("_good"), F.sum("bad").alias("_bad"))
              .select("_pid", *[F.coalesce(F.sum(f"_{c}").over(ranges), F.lit(0)).alias(f"_{c}") for c in ("good", "bad")]))
    inside = Window.partitionBy("_pid").orderBy("llr").rowsBetween(Window.unboundedPreceding, -1)
    below = r.join(starts, "_pid").withColumns({f"{c}_below": F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("good", "bad")})
    below = write_table(below.select("llr", "good", "bad", "good_below", "bad_below"), "scores")
    most = below.where(F.col("good_below") + F.col("good") > int((1 - passed) * n.good)).agg(F.min("llr")).first()[0]
    if not n.bad:
        return float(most)
    # a threshold passes the scores from it on; between two scores it passes what the higher one does
    at = below.where((F.col("llr") <= most) & ((F.col("good") > 0) | (F.col("llr") < most)))
    at = at.withColumn("gain", (n.good - F.col("good_below")) / n.good - (n.bad - F.col("bad_below")) / n.bad)
    best = at.where(F.col("gain") >= at.agg(F.max("gain")).first()[0] - 1e-12).agg(F.min("llr")).first()[0]
    before = at.where(F.col("llr") < best).agg(F.max("llr")).first()[0]
    return float(best if before is None else (best + before) / 2)


def quality_rules(docs: DataFrame, labels: DataFrame, passed: float = PASSED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, base counts, base_failed, llr and kept.

    The target multinomial is counted on all texts labelled quality 1 whose doc_id hashes to one half, the raw one on
    all texts. The threshold is set on all labelled texts but those and holds for every text. Null texts have no word and fail the base rule; repeated rows count as often as they occur; a
    null doc_id has no label; without labels only the base rule decides; no rows give no rows.
    """
    in_half = lambda c: F.pmod(F.xxhash64(F.lit(23), F.col(c).cast("long")), F.lit(2)) == 0
    half = in_half("doc_id")
    good, bad = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False))
    flag = lambda c, name: F.max(c.cast("int")).alias(name)
    known = write_table(labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(flag(good & half, "trusted"), flag(good & ~half, "good"), flag(bad, "bad")), "labels")
    ids = known.where("trusted = 1").select(F.col("doc_id").alias("_t"), F.lit(True).alias("_trusted"))
    plain = docs.select(F.col(text).alias("_text"), F.col(doc_id).cast("long").alias("_id"))
    # only texts of the half can be trusted: the others need no look-up and stay where they are
    looked_up = plain.where(in_half("_id")).join(ids.hint("merge"), F.col("_id") == F.col("_t"), "left").select("_text", "_trusted")
    marked = looked_up.unionByName(plain.where(~in_half("_id")).select("_text", F.lit(False).alias("_trusted")))
    ratios = log_ratios(*gram_counts(marked, "_text", "_trusted"))
    rows = score(docs, ratios, text, doc_id)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = write_table(rows.withColumn("base_failed", failed), "quality")
    passing = rows.where(~F.col("base_failed")).groupBy("doc_id").agg(F.min("llr").alias("llr"))  # a label counts once
    threshold = threshold_of(passing.join(known.where("good + bad > 0"), "doc_id").select("llr", "good", "bad"), passed)
    return rows.withColumn("threshold", F.lit(threshold)).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
