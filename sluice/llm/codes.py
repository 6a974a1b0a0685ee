"""Vector code compression by member-resident Lloyd rounds (product quantisation with integers).

Vectors are cut into equal parts; every part position has its own codebook. The parts live with their
codebook entry: rows are partitioned by (position, entry, salt), and an owner keeps its members as one
packed row of a bucketed table. A round goes over the owners:

1. An owner sums its resident members; the sums of the salts of an entry give the new entry.
2. An owner compares its members with the new entries. Members that stay are not shuffled: the next table
   is a co-group of the old one, read by bucket without an exchange, with the movers.
3. Only the parts whose entry changed go through the shuffle, to the owner of their new entry.

The salt is a hash of a vector's block of rows, so an entry that a third of all vectors choose has as many
owners as any other share of the rows asks for.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._packed import pack, runs, unpack
from sluice.session import scratch_path, write_table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows of a block (they share a salt), and vectors of one salt, about: at most so many members an owner.
BLOCK, MEMBERS = 1 << 14, 1 << 17
#: Packed bytes of residents in one bucket of the table, about.
BUCKET_BYTES = 64 << 20
OWNER = ["position", "entry", "salt"]
_RESIDENT = "position int, entry int, salt int, members binary, total array<long>"
_MOVER = "position int, entry int, salt int, members binary"


def quantised(vectors: DataFrame, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and vec: floor(scale * x) of each component x as double. Vectors that are null or hold
    null or non-finite components are dropped."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    vec = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return vectors.where(x.isNotNull()).where(finite).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), vec.alias("vec"))


def _small(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest integer type that holds them."""
    top = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)) - 1)
    return matrix.astype(np.int8 if top < 128 else np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _members(rows: np.ndarray, parts: np.ndarray) -> bytes:
    return pack(rows, _small(parts).ravel())


def _unpacked(value: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows, flat = unpack(bytes(value))
    return rows, flat.reshape(len(rows), width).astype(np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``entries`` (squared distance, ties to the lower index) for each row of
    ``parts``, and that distance. Exact: floating point only where all sums are exact in it."""
    index, least = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
    top = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    exact = 4 * top * top * max(1, parts.shape[1]) < 1 << 52
    e = entries.astype(np.float64) if exact else entries
    own = (e * e).sum(1)
    for i in range(0, len(parts), 8192):
        p = parts[i : i + 8192]
        if exact:
            p = p.astype(np.float64)
            d = (p * p).sum(1)[:, None] + own[None, :] - 2 * (p @ e.T)
        else:
            d = np.stack([((p - x) ** 2).sum(1) for x in entries], 1)
        at = d.argmin(1)
        index[i : i + 8192] = at
        least[i : i + 8192] = d[np.arange(len(p)), at].astype(np.int64)
    return index, least


def _deal(rows: np.ndarray, matrix: np.ndarray, books: np.ndarray, salts: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The parts of some vectors by the owner of their nearest entry."""
    salt = salt_of(rows, salts)
    for position in range(books.shape[0]):
        w = books.shape[2]
        parts = matrix[:, position * w : (position + 1) * w]
        entry, _ = nearest(parts, books[position])
        yield from _by_owner(position, entry, salt, rows, parts)


def _by_owner(position: int, entry: np.ndarray, salt: np.ndarray, rows: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    key = salt * (1 << 20) + entry
    by = np.argsort(key, kind="stable")
    border = runs(key[by])
    for i, j in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        at = by[i:j]
        yield position, int(entry[at[0]]), int(salt[at[0]]), _members(rows[at], parts[at])


def salt_of(rows: np.ndarray, salts: int) -> np.ndarray:
    """The salt of the block of each row."""
    x = (rows // BLOCK).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(salts)).astype(np.int64)


def _batch(out: list[tuple], schema: tuple[tuple[str, pa.DataType], ...]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_PIECE = (("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("members", pa.binary()))


def _resident(key: tuple, rows: list[np.ndarray], parts: list[np.ndarray]) -> pd.DataFrame:
    """An owner's row: its members, by row, and their componentwise sum followed by their number."""
    if not sum(map(len, rows)):
        return pd.DataFrame([], columns=[*OWNER, "members", "total"])
    rows_, parts_ = np.concatenate(rows), np.concatenate(parts)
    by = np.argsort(rows_, kind="stable")
    return pd.DataFrame([(*key, _members(rows_[by], parts_[by]), [*parts_.sum(0).tolist(), len(rows_)])], columns=[*OWNER, "members", "total"])


def _store(df: DataFrame, buckets: int) -> DataFrame:
    """A table of owners in the checkpoint folder, bucketed by owner: grouping it by owner needs no exchange."""
    spark = df.sparkSession
    name = f"sluice_residents_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, *OWNER).option("path", scratch_path(spark, "residents")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the frame is resolved, and the files of a table with a path stay
    return table


def updated(books: np.ndarray, table: DataFrame) -> np.ndarray:
    """Entries replaced by the floor of the mean of their members, from the sums of all owners (the driver gets
    one row an entry); unused entries stay."""
    width = books.shape[2]
    sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width + 1)]
    new = books.copy()
    for r in table.select("position", "entry", "total").groupBy("position", "entry").agg(*sums).collect():
        new[r["position"], r["entry"]] = [int(r[f"s{i}"]) // int(r[f"s{width}"]) for i in range(width)]
    return new


def movers(table: DataFrame, books: np.ndarray) -> DataFrame:
    """Members whose nearest entry is no longer their owner's, by the owner they move to."""
    width = books.shape[2]

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for position, entry, salt, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, parts = _unpacked(value, width)
                to, _ = nearest(parts, books[position])
                gone = to != entry
                if gone.any():
                    out = list(_by_owner(position, to[gone], np.full(int(gone.sum()), salt), rows[gone], parts[gone]))
                    yield _batch(out, _PIECE)

    return table.select(*OWNER, "members").mapInArrow(leave, _MOVER)


def migrated(table: DataFrame, books: np.ndarray) -> DataFrame:
    """The owners once every member is with its nearest entry of ``books``: those that stay are read by bucket,
    only the movers are shuffled."""
    width = books.shape[2]

    def settle(key: tuple, stay: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        key = tuple(int(x) for x in key)
        rows, parts = [], []
        for value in stay["members"]:
            r, p = _unpacked(value, width)
            keep = nearest(p, books[key[0]])[0] == key[1]
            rows.append(r[keep])
            parts.append(p[keep])
        for value in come["members"]:
            r, p = _unpacked(value, width)
            rows.append(r)
            parts.append(p)
        return _resident(key, rows, parts)

    left = table.select(*OWNER, "members").groupBy(*OWNER)
    return left.cogroup(movers(table, books).groupBy(*OWNER)).applyInPandas(settle, _RESIDENT)


def settled(rows: DataFrame, books: np.ndarray, salts: int, buckets: int) -> DataFrame:
    """The first owners: every part at its nearest entry."""
    count, _, width = books.shape

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch.column(1).to_pylist(), count * width)
                yield _batch(list(_deal(batch.column(0).to_numpy(), matrix, books, salts)), _PIECE)

    def gather(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = [_unpacked(v, width) for v in frame["members"]]
        return _resident(tuple(int(x) for x in key), [r for r, _ in found], [p for _, p in found])

    dealt = rows.select("row", "vec").mapInArrow(deal, _MOVER).repartition(buckets, *OWNER)
    return dealt.groupBy(*OWNER).applyInPandas(gather, _RESIDENT)


def codes_of(table: DataFrame, books: np.ndarray) -> DataFrame:
    """row, code (two hex digits a part) and error of every vector, from the members of the owners."""
    count, _, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[np.empty(0, np.int64)] for _ in range(4)]
            for position, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, parts = _unpacked(value, width)
                entry, error = nearest(parts, books[position])
                for column, x in zip(found, (rows, np.full(len(rows), position), entry, error), strict=True):
                    column.append(x)
            rows, position, entry, error = (np.concatenate(c) for c in found)
            by = np.argsort(rows, kind="stable")
            border = runs(rows[by] // BLOCK)
            out = []
            for i, j in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
                at = by[i:j]
                out.append((int(rows[at[0]] // BLOCK), pack(rows[at], position[at].astype(np.uint8), entry[at].astype(np.uint8), error[at])))
            yield _batch(out, (("block", pa.int64()), ("packed", pa.binary())))

    def assemble(frame: pd.DataFrame) -> pd.DataFrame:
        rows, position, entry, error = (np.concatenate(c) for c in zip(*map(unpack, map(bytes, frame["packed"])), strict=True))
        by = np.lexsort((position, rows))
        rows, code, error = rows[by][::count], entry[by].reshape(-1, count), error[by].reshape(-1, count).sum(1)
        return pd.DataFrame({"row": rows, "code": ["".join(x) for x in digits[code].tolist()], "error": error})

    told = table.select("position", "members").mapInArrow(tell, "block long, packed binary")
    return told.groupBy("block").applyInPandas(assemble, "row long, code string, error long")


def _matrix(lists: list, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    m = np.zeros((len(lists), width), dtype=np.int64)
    for i, v in enumerate(lists):
        m[i, : len(v)] = v
    return m


def codebooks_sha256(books: np.ndarray) -> str:
    """Hash of all entries' decimal components by part, entry and position within the part, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, n: int) -> DataFrame:
    """Add label_error, the error summed over equal labels (nulls are one label). Labels with more than a
    thousandth of all rows, less than a thousand labels, are joined by broadcast: no label is one task."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")).withColumnRenamed("label", "_label")
    hot = sums.where(F.col("_n") > n // 1000).drop("_n")
    rest = sums.where(F.col("_n") <= n // 1000).select("_label", F.col("label_error").alias("_rest"))
    out = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    common, rare = out.where(F.col("label_error").isNotNull()), out.where(F.col("label_error").isNull()).drop("label_error")
    rare = rare.join(rest, F.col("label").eqNullSafe(F.col("_label"))).drop("_label").withColumnRenamed("_rest", "label_error")
    return common.unionByName(rare)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             members: int = MEMBERS, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Codes of all vectors: vec_id, label, code, error, label_error and codebooks_sha256, one row per kept row.

    Vectors that are null or hold null or non-finite components are dropped. Shorter vectors are filled with
    zeros up to the longest one's width, and that up to a multiple of ``parts``. The codebooks start as the
    parts of the ``entries`` smallest distinct vec_ids (of rows with one vec_id the smallest vector; null last);
    with fewer vectors they have fewer entries. Repeated rows are vectors of their own; ties go to the lower
    entry. Components so large that a squared distance would not fit in 64 bits are an error. An empty table
    gives no rows.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    spark = vectors.sparkSession
    rows = write_table(quantised(vectors, scale, vec_id, embedding, label).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, longest, most, least = rows.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(F.array_max("vec")), F.min(F.array_min("vec"))).first()
    width = max(1, -(-int(longest or 0) // parts))
    top = max(int(most or 0), -int(least or 0))
    if 4 * top * top * width * parts >= 1 << 62:
        raise ValueError(f"{embedding}: components of {top / scale:g} are too large for 64-bit squared distances")
    ids = [r[0] for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    chosen = rows.where(F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() & F.lit(None in ids)))
    first = chosen.groupBy("vec_id").agg(F.min("vec").alias("vec")).orderBy(F.col("vec_id").asc_nulls_last()).collect()  # at most ``entries`` rows
    books = _matrix([r["vec"] for r in first], parts * width).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    salts = max(1, -(-n // members))
    held = n * parts * (8 + 2 * width)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES))
    table = _store(settled(rows, books, salts, buckets), buckets)
    for r in range(rounds):
        books = updated(books, table)
        if r + 1 < rounds:
            table = _store(migrated(table, books), buckets)
    coded = codes_of(table, books)
    full = write_table(rows.select("row", "vec_id", "label").join(coded, "row").drop("row"), "codes")
    return (with_label_error(full, n).withColumn("codebooks_sha256", F.lit(codebooks_sha256(books)))
            .select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256"))
