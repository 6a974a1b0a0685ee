"""Structured Streaming forms of the keyed-state operators.

The reference keeps cache state with TTLs, counters and an upsert sink; here
they are streaming queries over the access log:

* ``residency_sessions``  sessions (gap < TTL: 1 miss + n-1 hits) as keyed state with timeouts: closed ones
                          are reported once and forgotten, open ones when they change
* ``fixed_ttl_flags``     hits and misses of the fixed TTL as keyed state with timeouts
* ``fixed_ttl_by_batch``  the same with each micro-batch as range slices, for keys too hot for one task;
                          the state is a table of the changes of each batch
* ``first_seen``          the misses of that rule: keys that are not cached
* ``access_counts``       running count / last access per key (update mode)
* ``window_metrics``      hits, misses and times per tumbling window
* ``upsert_sink``         foreachBatch -> keyed upsert into hash buckets, versioned

Sinks write parquet (``foreachBatch``, one folder per batch id, so a replayed
batch overwrites itself) in the shared checkpoint folder; nothing is collected
to the driver. ``events.ts`` is TIMESTAMP_NTZ, which watermarks reject, so the
stream casts it to TIMESTAMP first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators.access import anchors_of, first_at, fixed_ttl_anchors
from sluice.operators.merge import upsert_results
from sluice.session import remove_path, scratch_path, write_table
from sluice.sources.tables import table_path

WATERMARK = "1 hour"


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream-{name}")


def access_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The events table read as a file stream, shaped like ``bindings.access_log``."""
    path = table_path(sf_dir, "events")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # a file source watches a folder or a glob; a one-file table is read through
    # a glob that matches just that file
    ev = reader.parquet(path if not path.endswith(".parquet") else path[:-1] + "[t]")
    return ev.select(
        F.col("event_type").alias("instance"), F.col("user_id").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.col("value").alias("op_ms"), (F.col("event_type") == "error").alias("is_error"),
    )


def run_to_parquet(df: DataFrame, out: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Run a streaming query to completion (availableNow) with a parquet
    foreachBatch sink: batch ``b``, or what ``each`` makes of it, lands in ``out/batch_id=b`` (idempotent)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (each(batch) if each else batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (df.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def run_in_parts(df: DataFrame, out: str, arrive: list[Callable[[], None]], mode: str = "append",
                 each: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """``run_to_parquet`` once for each part of a log that arrives in parts: every run is the same query, started
    again from its checkpoint, and sees the files that are new."""
    for step in arrive:
        step()
        run_to_parquet(df, out, mode, each)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state in RocksDB, so that it need not fit into memory; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Hash buckets of the keys of a keyed state. One call of a state function handles a bucket: its rows of the micro-batch
#: and the entries that it holds, all keys at once.
STATE_BUCKETS = 1024


def _by_bucket(stream: DataFrame, handle: Callable, schema: str, columns: Sequence[str], mode: str, buckets: int) -> DataFrame:
    """``handle`` over the hash buckets of (instance, key), with a packed table of entries as the state of a bucket and
    an event-time timeout. Instance and key travel as text, so that null keys stay null and long ones exact."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in ("instance", "key")}
    text = [F.col(c).cast("string").alias(c) for c in kinds]
    rows = stream.withWatermark("ts", WATERMARK).select(F.pmod(F.xxhash64("instance", "key"), F.lit(buckets)).cast("int").alias("bucket"), *text, *columns)
    found = rows.groupBy("bucket").applyInPandasWithState(handle, f"instance string, key string, {schema}", "held binary", mode, GroupStateTimeout.EventTimeTimeout)
    return found.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def _entries(state: GroupState, columns: Sequence[str]) -> pd.DataFrame:
    """The entries that a bucket holds: instance, key and the given numbers."""
    if state.exists:
        return pa.ipc.open_stream(bytes(state.get[0])).read_pandas()
    return pd.DataFrame({"instance": pd.Series(dtype=object), "key": pd.Series(dtype=object), **{c: np.empty(0, np.int64) for c in columns}})


def _hold(state: GroupState, entries: pd.DataFrame, ends_ms: np.ndarray) -> None:
    """Keep the entries, and a timeout at the first watermark (after the present one) at which one of them ends."""
    if len(entries):
        table, packed = pa.Table.from_pandas(entries, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(packed, table.schema) as out:
            out.write_table(table)
        state.update((packed.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(max(1, int(ends_ms.min()) - 1))  # a timeout comes when the watermark is above it
    elif state.exists:
        state.remove()


def _numbers(*frames: pd.DataFrame) -> list[np.ndarray]:
    """Numbers of the (instance, key) pairs, the same in all frames."""
    pairs = pd.concat([f[["instance", "key"]] for f in frames], ignore_index=True)
    number = pairs.groupby(["instance", "key"], dropna=False, sort=False).ngroup().to_numpy()
    return np.split(number, np.cumsum([len(f) for f in frames])[:-1])


def _batch(rows: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """A bucket's rows of one micro-batch; None if it was only called because of its timeout."""
    parts = [pdf for pdf in rows if len(pdf)]
    return pd.concat(parts, ignore_index=True) if parts else None


def _micros(ts: pd.Series) -> np.ndarray:
    return pd.to_datetime(ts, utc=True).dt.tz_localize(None).to_numpy(dtype="datetime64[us]").astype(np.int64)


def _milliseconds(us: np.ndarray) -> np.ndarray:
    """Milliseconds of the watermark that are not before the given microseconds."""
    return -(-us // 1000)


def _merge(number: np.ndarray, start: np.ndarray, last: np.ndarray, count: np.ndarray, ttl_us: int) -> tuple[np.ndarray, ...]:
    """``merge_sessions`` of many keys, told apart by their numbers: number, start, last and count."""
    by = np.lexsort((start, number))
    number, start, last, count = number[by], start[by], last[by], count[by]
    reach = pd.Series(last).groupby(number).cummax().to_numpy()
    new = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (start[1:] - reach[:-1] >= ttl_us)))
    return number[new], start[new], np.maximum.reduceat(last, new), np.add.reduceat(count, new)


def merge_sessions(start: np.ndarray, last: np.ndarray, count: np.ndarray, ttl_us: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of accesses joined where one begins less than the TTL after an earlier one's last access."""
    return _merge(np.zeros(len(start), np.int64), start, last, count, ttl_us)[1:]


def _sessions(ttl_us: int) -> Callable:
    """State of a bucket: start, last access and number of accesses of its keys' open sessions (more than one a key
    only while the watermark still allows rows between them). A session closes when the watermark has passed its last
    access by the TTL: it is reported and dropped."""
    numbers = ["start_us", "last_us", "accesses"]

    def handle(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, batch = _entries(state, numbers), _batch(rows)
        touched = np.zeros(len(held), dtype=bool)
        if batch is not None:
            ts = _micros(batch["ts"])
            single = pd.DataFrame({"instance": batch["instance"], "key": batch["key"], "start_us": ts, "last_us": ts, "accesses": np.ones(len(ts), np.int64)})
            new = _numbers(held, single)
            both, number = pd.concat([held, single], ignore_index=True), np.concatenate(new)
            _, one = np.unique(number, return_index=True)  # a row of each pair
            number, *values = _merge(number, *[both[c].to_numpy(np.int64) for c in numbers], ttl_us)
            held = both[["instance", "key"]].iloc[one[number]].reset_index(drop=True).assign(**dict(zip(numbers, values, strict=True)))
            touched = np.isin(number, new[1])
        ends = _milliseconds(held["last_us"].to_numpy(np.int64) + ttl_us)
        done = ends <= state.getCurrentWatermarkMs()
        _hold(state, held[~done], ends[~done])
        told = done | touched
        if told.any():
            yield held.assign(closed=done)[told]

    return handle


def residency_sessions(stream: DataFrame, ttl_seconds: int, buckets: int = STATE_BUCKETS) -> DataFrame:
    """A key stays cached while accesses are closer than the TTL: instance, key, start_us, last_us, accesses,
    closed. A session is reported with closed = false whenever it changes and once with closed = true, when
    the state forgets it; ``latest_sessions`` folds these rows. Keys are held in ``buckets`` hash buckets, and a
    micro-batch writes those that its rows or ended sessions are in. Run in update mode."""
    return _by_bucket(stream, _sessions(ttl_seconds * 1_000_000), "start_us long, last_us long, accesses long, closed boolean", ["ts"], "update", buckets)


def latest_sessions(updates: DataFrame, ttl_seconds: int) -> DataFrame:
    """Every session once, open ones as they stand. Reports of one session share accesses: of the reports of a key
    the longest that holds each last access stays (sessions only grow, and merge with their neighbours)."""
    ttl_us = ttl_seconds * 1_000_000
    g = updates.groupBy("instance", "key", "start_us").agg(F.max_by(F.struct("last_us", "accesses", "closed"), F.struct("last_us", "accesses", "closed")).alias("r"))
    # an earlier report of a session that merged with an older one lies inside it
    w = Window.partitionBy("instance", "key").orderBy("start_us").rowsBetween(Window.unboundedPreceding, -1)
    g = g.select("instance", "key", "start_us", "r.*").withColumn("_reach", F.max("last_us").over(w))
    g = g.where(F.col("_reach").isNull() | (F.col("start_us") - F.col("_reach") >= ttl_us))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return g.select("instance", "key", at(F.col("start_us")).alias("session_start"), at(F.col("last_us") + (ttl_us - 1)).alias("session_end"),
                    "accesses", (F.col("accesses") - 1).alias("hits"), F.lit(1).alias("misses"), "closed")


def first_seen(flags: DataFrame) -> DataFrame:
    """Miss stream: accesses of keys that are not cached, from the flags of ``fixed_ttl_by_batch``. A key
    comes again once its entry has expired, whatever the micro-batches are."""
    return flags.filter(~F.col("hit")).drop("hit")


def _fixed_ttl(ttl_us: int, columns: list[str]) -> Callable:
    """State of a bucket: the set times of its keys' entries; a hit does not renew one. An entry is dropped once the
    watermark is at its set time + TTL: any later access misses anyway."""

    def handle(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, batch = _entries(state, ["anchor_us"]), _batch(rows)
        if batch is not None:
            ts, anchor = _micros(batch["ts"]), held["anchor_us"].to_numpy(np.int64)
            old, number = _numbers(held, batch)
            by = np.lexsort((batch["seq"].to_numpy(), ts, number) if "seq" in batch else (ts, number))
            batch, run, ts = batch.iloc[by], number[by], ts[by]
            starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            seen = np.isin(old, run)
            # a held entry is left at its set time + TTL, other keys enter at their first row
            left = first_at(run, ts, old[seen], anchor[seen] + ttl_us)
            left = left[(left < len(run)) & (run[np.minimum(left, len(run) - 1)] == old[seen])]
            missed = anchors_of(run, ts, ttl_us, np.concatenate([starts[~np.isin(run[starts], old)], left]))
            yield batch[["instance", "key", *columns]].assign(hit=~missed)
            at = np.flatnonzero(missed)
            at = at[np.append(run[at][1:] != run[at][:-1], True)[: len(at)]]  # the last of each key
            set_now = batch[["instance", "key"]].iloc[at].assign(anchor_us=ts[at])
            held = pd.concat([held[~np.isin(old, run[at])], set_now], ignore_index=True)
        ends = _milliseconds(held["anchor_us"].to_numpy(np.int64) + ttl_us)
        live = ends > state.getCurrentWatermarkMs()
        _hold(state, held[live], ends[live])

    return handle


def fixed_ttl_flags(stream: DataFrame, ttl_seconds: int, buckets: int = STATE_BUCKETS) -> DataFrame:
    """The columns of the stream with ``hit`` under the fixed TTL: set times as state with event-time timeouts, in
    ``buckets`` hash buckets of the keys, so that a micro-batch makes one call a bucket and not one a key, and expired
    entries are dropped. Rows older than their key's set time are hits.

    A micro-batch's rows of one bucket are handled together, bounded by the trigger size (maxFilesPerTrigger /
    maxBytesPerTrigger).
    """
    rest = [f.name for f in stream.schema.fields if f.name not in ("instance", "key")]
    schema = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in rest) + ", hit boolean"
    return _by_bucket(stream, _fixed_ttl(ttl_seconds * 1_000_000, rest), schema, rest, "append", buckets)


def fixed_ttl_by_batch(stream: DataFrame, ttl_seconds: int, out: str, arrive: list[Callable[[], None]] | None = None, late_seconds: int = 3600) -> str:
    """Fixed TTL with the state in tables of changes instead of the state store, for keys too hot for one task.

    Each micro-batch runs the distributed ``fixed_ttl_anchors`` (range slices; no key is ever one task) over its
    rows, seeded with the set time of their keys, and writes the set times it changes as ``out/state/b<batch>-<latest
    set time>``. The state is the latest set time of each key in these tables: nothing is written twice, and a table
    whose latest entry has expired ``late_seconds`` before the batch's first row is removed unread. Rows older than
    their key's set time are hits (the entry is still cached). Flags land in ``out/flags/batch_id=b``; a replayed
    batch is skipped. With ``arrive`` the query runs once for each part of the log. Returns the flags folder.
    """
    spark = stream.sparkSession
    ttl_us = ttl_seconds * 1_000_000
    state_schema = "instance string, key long, anchor_ts timestamp"
    more = ["instance", "key", "seq", "ts", "op_ms", "is_error"]

    def apply(batch: DataFrame, batch_id: int) -> None:
        if _exists(spark, f"{out}/done/{batch_id}/_SUCCESS"):
            return
        rows = write_table(batch.select(*more), "batch")
        span = rows.agg(F.unix_micros(F.min("ts")).alias("lo")).first()
        if span.lo is not None:
            live = []
            for name in _names(spark, f"{out}/state"):
                if int(name.split("-")[1]) + ttl_us + late_seconds * 1_000_000 < span.lo:
                    remove_path(spark, f"{out}/state/{name}")
                elif int(name[1:].split("-")[0]) < batch_id:
                    live.append(f"{out}/state/{name}")
            held = spark.read.schema(state_schema).parquet(*live) if live else spark.createDataFrame([], state_schema)
            now = held.groupBy("instance", "key").agg(F.max("anchor_ts").alias("anchor_ts"))
            known = write_table(rows.join(now, ["instance", "key"], "left"), "batch")
            fresh = known.where(F.col("anchor_ts").isNull() | (F.col("ts") >= F.col("anchor_ts")))
            late = known.where(F.col("anchor_ts") > F.col("ts"))
            seeds = (fresh.where(F.col("anchor_ts").isNotNull()).select("instance", "key", "anchor_ts").distinct()
                     .select("instance", "key", F.col("anchor_ts").alias("ts"), F.lit(-1).cast("long").alias("seq")))
            log = fresh.select("instance", "key", "ts", "seq").unionByName(seeds)
            anchors = write_table(fixed_ttl_anchors(log, ttl_seconds).withColumn("_miss", F.lit(True)), "anchors")
            flags = (fresh.join(anchors, ["instance", "key", "seq"], "left").select(*more, F.col("_miss").isNull().alias("hit"))
                     .unionByName(late.select(*more, F.lit(True).alias("hit"))))
            flags.write.mode("overwrite").parquet(f"{out}/flags/batch_id={batch_id}")
            changed = write_table(anchors.where("seq >= 0").join(rows.select("instance", "key", "seq", "ts"), ["instance", "key", "seq"])
                                  .groupBy("instance", "key").agg(F.max("ts").alias("anchor_ts")), "anchors")
            latest = changed.agg(F.unix_micros(F.max("anchor_ts"))).first()[0]
            if latest is not None:
                changed.write.mode("overwrite").parquet(f"{out}/state/b{batch_id}-{latest}")
        spark.range(0).write.mode("overwrite").parquet(f"{out}/done/{batch_id}")

    for step in arrive or [lambda: None]:
        step()
        q = (stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{out}/_checkpoint")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return f"{out}/flags"


def access_counts(stream: DataFrame) -> DataFrame:
    """Running access count and last access per key (update mode)."""
    return stream.groupBy("instance", "key").agg(F.count(F.lit(1)).alias("accesses"),
                                                 F.max("ts").alias("last_access"))


def latest_counts(updates: DataFrame) -> DataFrame:
    """Fold the update-mode rows of all batches into the current state."""
    return updates.groupBy("instance", "key").agg(F.max("accesses").alias("accesses"),
                                                  F.max("last_access").alias("last_access"))


def window_metrics(flags: DataFrame, window: str = "1 day") -> DataFrame:
    """Operations, hits, misses, errors and operation times per tumbling window of flags: of a micro-batch, or of
    a stream in update mode (open windows are reported too, and again when they change)."""
    w = F.window(F.col("ts"), window)
    ms = F.round(F.col("op_ms") * 100).cast("long")
    g = flags.groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("ops"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.count_if("is_error").alias("errors"), F.sum(F.when(F.col("hit"), ms).otherwise(0)).alias("hit_ms_e2"),
        F.sum(F.when(F.col("hit"), 0).otherwise(ms)).alias("miss_ms_e2"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "ops", "hits", "misses",
                    "errors", "hit_ms_e2", "miss_ms_e2")


def added_windows(counts: DataFrame) -> DataFrame:
    """The windows of ``window_metrics`` over micro-batches, added up."""
    values = [c for c in counts.columns if c not in ("window_start", "window_end", "batch_id")]
    return counts.groupBy("window_start", "window_end").agg(*[F.sum(c).alias(c) for c in values])


#: Hash buckets of the upsert sink's table; a micro-batch rewrites the buckets that its keys touch.
SINK_BUCKETS = 32


def upsert_sink(results_stream: DataFrame, base: DataFrame, out: str, buckets: int = SINK_BUCKETS) -> list[str]:
    """``INSERT ... ON CONFLICT`` as a streaming sink.

    Version 0 is ``base`` in hash buckets of the key; micro-batch ``b`` reads
    the newest version of the buckets it touches, applies ``upsert_results`` and
    writes those buckets as version ``b + 1`` (never reading and writing the
    same folder); the buckets they replace are removed then, so each is stored
    once. A replayed batch finds its version and skips it. Returns the newest
    folder of each bucket.
    """
    spark = results_stream.sparkSession
    columns = base.columns
    bucket = F.pmod(F.xxhash64("question_id"), F.lit(buckets)).cast("int")

    def put(df: DataFrame, version: int) -> None:
        df.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/v{version}")

    def newest() -> dict[int, str]:
        found = {}
        for v in sorted(v for v in _versions(spark, out) if _exists(spark, f"{out}/v{v}/_SUCCESS")):
            found |= {b: f"{out}/v{v}/bucket={b}" for b in _versions(spark, f"{out}/v{v}", "bucket=")}
        return found

    def apply(batch: DataFrame, batch_id: int) -> None:
        target = batch_id + 1
        if _exists(spark, f"{out}/v{target}/_SUCCESS"):
            return
        now = newest()
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        paths = [now[b] for b in touched if b in now]
        stored = spark.read.schema(base.schema).parquet(*paths) if paths else spark.createDataFrame([], base.schema)
        put(upsert_results(stored, batch), target)
        for p in paths:  # replaced, and a replay of this batch finds its version
            remove_path(spark, p)

    if not _exists(spark, f"{out}/v0/_SUCCESS"):
        put(base.select(*columns), 0)
    q = (results_stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return [p for _, p in sorted(newest().items())]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder that exists; a part without rows has none."""
    fs, p = _fs(spark, source)
    if fs.exists(p):
        to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(to.getParent())
        fs.rename(p, to)


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem (works on shared stores)."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, p = _fs(spark, folder)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def _versions(spark: SparkSession, out: str, prefix: str = "v") -> list[int]:
    """Numbers of the sub-folders named prefix + number."""
    fs, p = _fs(spark, out)
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return [int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()]
