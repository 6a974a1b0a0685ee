"""Language identification with a byte convolutional network, trained in numpy.

A text is cut into windows of ``WINDOW`` bytes. Filters of several widths slide over a window's bytes,
each filter keeps its largest response (max pooling), and a softmax over these gives the languages. A
text's probabilities are the means over its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import write_table

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 8
#: Bounds of the training sample: ids of a language (those of the smallest hash), windows of a row, and ids of
#: all languages (shared evenly, but one of each language at least).
ROWS, WINDOWS, TOTAL = 600, 6, 38_400
#: Windows scored at once.
BATCH = 256
UNKNOWN = "und"


@dataclass
class Network:
    """``filters[w]``: (w, 257, FILTERS) responses to byte b at each place (256: past the end);
    ``dense``: (filters of all widths, languages); ``bias``; ``languages`` in order."""

    languages: list[str]
    filters: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray


def cut(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (rows of byte numbers, 256 past the end), bytes in each, and text of each."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    count = -(-n // window)
    text = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n[text] - place * window, window)
    padded = np.full(int(count.sum()) * window, 256, dtype=np.int16)
    at = np.repeat((np.cumsum(count) - count) * window, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    padded[at] = np.frombuffer(b"".join(texts), np.uint8)
    return padded.reshape(-1, window), size, text


def _responses(net: Network, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pooled responses of the windows and, by width, the places where they arise."""
    pooled, places = [], []
    for f in net.filters:
        w = len(f)
        m = x.shape[1] - w + 1
        r = f[0][x[:, :m]]
        for k in range(1, w):
            r += f[k][x[:, k : k + m]]
        at = r.argmax(1)
        places.append(at)
        pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
    return np.maximum(np.concatenate(pooled, 1), 0), places


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def pick(text: bytes, seed: int, windows: int = WINDOWS, window: int = WINDOW) -> list[bytes]:
    """At most ``windows`` windows from anywhere in a text, each third one cut short, as short texts are."""
    draw = np.random.default_rng(seed)
    parts = []
    for k in draw.permutation(-(-len(text) // window))[:windows]:
        part = text[k * window : (k + 1) * window]
        parts.append(part[: int(draw.integers(4, window))] if draw.random() < 1 / 3 else part)
    return parts


def train(parts: list[bytes], labels: list[str], window: int = WINDOW, widths: tuple[int, ...] = WIDTHS, filters: int = FILTERS,
          epochs: int = 6, rate: float = 0.01, seed: int = 3) -> Network:
    """A network fitted by Adam to labelled windows."""
    languages = sorted(set(labels))
    draw = np.random.default_rng(seed)
    number = {name: k for k, name in enumerate(languages)}
    target = np.array([number[label] for label in labels])
    x, _, _ = cut(parts, window)
    net = Network(languages, [draw.normal(0, 0.3, (w, 257, filters)).astype(np.float32) for w in widths],
                  draw.normal(0, 0.2, (len(widths) * filters, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    weights = [*net.filters, net.dense, net.bias]
    first, second = [np.zeros_like(v) for v in weights], [np.zeros_like(v) for v in weights]
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for i in range(0, len(x), 64):
            rows = order[i : i + 64]
            b = x[rows]
            pooled, places = _responses(net, b)
            error = _softmax(pooled @ net.dense + net.bias)
            error[np.arange(len(rows)), target[rows]] -= 1
            error /= len(rows)
            back = (error @ net.dense.T) * (pooled > 0)
            gradient = []
            for j, (f, at) in enumerate(zip(net.filters, places, strict=True)):
                g = np.zeros_like(f)
                part = back[:, j * filters : (j + 1) * filters]
                which = np.broadcast_to(np.arange(filters), at.shape)
                for k in range(len(f)):
                    np.add.at(g[k], (np.take_along_axis(b, at + k, 1), which), part)
                gradient.append(g)
            gradient += [pooled.T @ error, error.sum(0)]
            step += 1
            for v, g, m, s in zip(weights, gradient, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
    return net


class Scorer:
    """Probabilities of texts. Neighbouring bytes are looked up as one number, filter by filter, so that a
    filter costs one or two reads a place and its largest response is taken along adjacent memory."""

    def __init__(self, net: Network):
        self.net = net
        self.tables = []  # per filter: width, response to the first two bytes, to the others
        for f in net.filters:
            for j in range(f.shape[2]):
                head = (f[0][:, None, j] + f[1][None, :, j]).ravel()
                rest = None if len(f) == 2 else f[2][:, j].copy() if len(f) == 3 else (f[2][:, None, j] + f[3][None, :, j]).ravel()
                self.tables.append((len(f), head, rest))

    def windows(self, x: np.ndarray) -> np.ndarray:
        net, m = self.net, x.shape[1]
        x = x.astype(np.intp)
        pair = x[:, :-1] * 257 + x[:, 1:]
        by_width = {2: (pair, None), 3: (np.ascontiguousarray(pair[:, : m - 2]), np.ascontiguousarray(x[:, 2:])),
                    4: (np.ascontiguousarray(pair[:, : m - 3]), np.ascontiguousarray(pair[:, 2:]))}
        pooled = np.empty((len(x), len(self.tables)), dtype=np.float32)
        for j, (w, head, rest) in enumerate(self.tables):
            a, b = by_width[w]
            r = head.take(a, mode="clip")
            if rest is not None:
                r += rest.take(b, mode="clip")
            r.max(1, out=pooled[:, j])
        return _softmax(np.maximum(pooled, 0) @ net.dense + net.bias)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages); a text without bytes gets zeros."""
        total = np.zeros((len(texts), len(self.net.languages)))
        bytes_ = np.zeros(len(texts))
        for group in _groups(texts, BATCH * WINDOW):
            x, size, text = cut([texts[i] for i in group])
            text = np.array(group)[text]
            for i in range(0, len(x), BATCH):
                p = self.windows(x[i : i + BATCH]) * size[i : i + BATCH, None]
                np.add.at(total, text[i : i + BATCH], p)
                np.add.at(bytes_, text[i : i + BATCH], size[i : i + BATCH])
        return total / np.maximum(bytes_, 1)[:, None]


def _groups(texts: list[bytes], limit: int) -> Iterator[list[int]]:
    group, held = [], 0
    for i, t in enumerate(texts):
        if group and held + len(t) > limit:
            yield group
            group, held = [], 0
        group.append(i)
        held += len(t)
    if group:
        yield group


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def smallest(named: DataFrame, rows: int, total: int) -> tuple[DataFrame, bool]:
    """The ``rows`` ids (fewer if all languages together would have more than ``total``) of the smallest hash of every
    language of ``named`` (_lang, _id, _hash), and whether they are few enough to be broadcast.

    The number of ids of a language, estimated by partial aggregates, gives a hash below which about twice as many
    ids lie as are wanted; only these are shuffled and ranked, whatever the number of rows and tasks.
    """
    sizes = write_table(named.groupBy("_lang").agg(F.approx_count_distinct("_hash", 0.03).alias("_ids")), "languages")
    languages = sizes.count()
    each, few = min(rows, max(total // max(languages, 1), 1)), languages <= total
    share = F.lit(2.0 * each + 200) / F.greatest(F.col("_ids"), F.lit(1))
    below = sizes.select("_lang", (F.least(share, F.lit(1.0)) * 2.0**64 - 2.0**63).alias("_below"))
    near = named.join(F.broadcast(below) if few else below, "_lang").where(F.col("_hash").cast("double") <= F.col("_below"))
    first = Window.partitionBy("_lang").orderBy("_hash", "_id")
    ranked = near.select("_lang", "_id", "_hash").distinct().withColumn("_n", F.row_number().over(first))
    return ranked.where(F.col("_n") <= each).select("_lang", "_id"), few


def fit(docs: DataFrame, rows: int = ROWS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", total: int = TOTAL, **options) -> Network | None:
    """A network learned from a bounded sample of the rows with a language that are not held out: ``rows`` ids of
    every language, fewer each if these are more than ``total``, of an id ``WINDOWS`` windows of its largest text.
    None if there is no such row."""
    known = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull())
    named = known.select(F.col(lang).alias("_lang"), F.col(doc_id).alias("_id"), F.xxhash64(F.lit(11), F.col(doc_id)).alias("_hash"))
    sample, few = smallest(named, rows, total)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for name, key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in pick(body or b"", key & 0xFFFFFFFF):
                    langs.append(name)
                    parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["lang", "part"])

    chosen = F.broadcast(sample) if few else sample  # at most ``total`` ids
    held = (known.select(F.col(lang).alias("_lang"), F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text"))
            .join(chosen, ["_lang", "_id"]).groupBy("_lang", "_id").agg(F.max("_text")).mapInArrow(windows, "lang string, part binary").collect())
    held = sorted((r["lang"], bytes(r["part"])) for r in held if r["part"])
    return train([p for _, p in held], [n for n, _ in held], **options) if held else None


def identify(docs: DataFrame, net: Network | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, lang_pred and score, the probability of that language over the whole text.

    ``und`` with score 0 for null texts and texts without a letter (and for all texts if nothing could be
    learned). Equal probabilities go to the smaller language name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 9 * 257 * FILTERS numbers, about 75 kB

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            lettered = np.array(batch.column(2).to_pylist(), dtype=bool)
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            at = np.flatnonzero(lettered)
            if scorer and len(at):
                p = scorer([batch.column(1)[int(i)].as_py() for i in at])
                best = p.argmax(1)
                scores[at] = np.clip(p[np.arange(len(at)), best], 0, 1)
                for i, b in zip(at, best, strict=True):
                    names[i] = scorer.net.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def keep_recognised(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """``docs`` without the rows whose language cannot be told: null texts, texts without a letter, and those
    that give no language a probability of ``least``."""
    net = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(bodies):
        import pandas as pd

        if shared.value is None:
            return pd.Series(np.ones(len(bodies)))
        return pd.Series(Scorer(shared.value)([b.encode() for b in bodies]).max(1) if len(bodies) else np.zeros(0))

    return docs.where(F.col("text").rlike(r"\p{L}")).where(score(F.col("text")) >= least)

