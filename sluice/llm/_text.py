"""Vectorised words and word hashes over blocks of texts (numpy inside Spark tasks)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multiplier of the rolling polynomial of word hashes modulo 2**64 (3 modulo 8: swaps lose one bit at most).
WORD_BASE = 0xC2B2AE3D27D4EB4B
#: Bytes of text whose words are hashed at once.
_SEGMENT = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix64 finaliser)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept for the next call)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        pair = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (pair[0], pair[1])
    return have[0][:n], have[1][:n]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block of texts given as UTF-8 bytes (None: no word).

    ``starts``/``ends`` are byte positions in ``buf``; the words of text ``i`` are
    ``offsets[i]:offsets[i + 1]``.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        self.raw = b"\n".join([b"", *[t or b"" for t in texts], b""])
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        blank = (self.buf == 32) | ((self.buf >= 9) & (self.buf <= 13))
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # starts blank and ends blank: start, end, start, end ...
        self.starts, self.ends = edge[0::2], edge[1::2]
        at = np.cumsum([1] + [len(t or b"") + 1 for t in texts])
        self.offsets = np.searchsorted(self.starts, at)
        self.text_at = at
        self.lower = lower

    def hashes(self, bits: int = 64) -> np.ndarray:
        """A hash of each word's bytes (BLAKE2b): 64-bit numbers, or two columns of them for 128 ``bits``."""
        wide = bits // 64
        out = np.empty((len(self.starts), wide), dtype=U64)
        i, n = 0, len(self.starts)
        while i < n:  # segments of whole words: the words of one segment are held as objects
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + _SEGMENT, side="right")))
            part = self.raw[int(self.starts[i]) : int(self.ends[j - 1])]
            words = (part.translate(_LOWER) if self.lower else part).split()  # splits at the same bytes
            place = {w: k for k, w in enumerate(dict.fromkeys(words))}
            digests = np.frombuffer(b"".join([blake2b(w, digest_size=8 * wide).digest() for w in place]), dtype="<u8").reshape(-1, wide)
            out[i:j] = digests[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]
            i = j
        return out[:, 0].copy() if wide == 1 else out

    def lengths(self) -> np.ndarray:
        """Number of words of each text."""
        return np.diff(self.offsets)


def windows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling hash of every ``width`` consecutive words of one text: (hash, index of text, start
    within the text), in text order. Texts with fewer words have no window."""
    n = len(hashes)
    if n < width:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    power, inverse = powers(WORD_BASE, n + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(hashes * power[:n], out=total[1:])
    first = np.arange(n - width + 1)
    rolled = mix64((total[width:] - total[: n - width + 1]) * inverse[: n - width + 1])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[: n - width + 1] == text[width - 1 :]
    first, text = first[inside], text[: n - width + 1][inside]
    return rolled[inside], text, first - offsets[text]


def blocks(batches: Iterator[pa.RecordBatch], text_column: str, limit: int) -> Iterator[dict[str, list]]:
    """Rows of Arrow batches as lists by column, in blocks of at most ``limit`` text bytes (one row at least)."""
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(columns[text_column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        i = 0
        while i < batch.num_rows:
            j, total = i + 1, int(sizes[i])
            while j < batch.num_rows and total + sizes[j] <= limit:
                total += int(sizes[j])
                j += 1
            yield {name: c.slice(i, j - i).to_pylist() for name, c in columns.items()}
            i = j


def table_bytes(spark, df, columns: list[str]) -> int:
    """Total UTF-8 bytes of text columns: one cheap scan that sizes the number of hash buckets."""
    from pyspark.sql import functions as F

    total = df.agg(*[F.sum(F.octet_length(F.col(c))).alias(f"t{i}") for i, c in enumerate(columns)]).first()
    return sum(int(x or 0) for x in total)


def release() -> None:
    """Give this worker's freed memory back to the system: Spark's Python workers live on for the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
