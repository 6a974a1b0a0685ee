"""Access-log (cache) analytics.

The reference replays random look-ups through a live cache. Here the same
questions are answered from an access log ``(instance, key, ts, seq, op_ms,
is_error)`` with set-based Spark jobs:

* ``sequence_log``   dense position per instance and the previous access of
                     the same key (skew-safe range scans, see ``sequence``)
* ``ttl_hits_sliding`` hit iff the previous access is less than TTL ago
* ``fixed_ttl_anchors`` expiry counted from the set; slices walk from anchor to
                     anchor and pass only the carried anchor on
* ``reuse_distance`` distinct other keys since the previous access (true LRU
                     stack distance), a dominance count (see ``dominance``)
* ``access_flags``   reuse distance, sliding-TTL hit, and for accesses whose entry
                     expires unread the distinct keys until then
* ``hit_rate_curve`` hit rate for every cache size from one histogram
* ``access_metrics`` per (policy, size) counters and rates; ``ttl_metrics`` per TTL

Instances are separate caches (instance = event_type for the events table).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.numeric import idiv, round_ratio
from sluice.functions.scoring import SPACE, hash60
from sluice.operators.dominance import BLOCK, CHUNK, FANOUT, dominance_counts
from sluice.operators.sequence import dense_position, held_slices, sequence_within, stored_slices
from sluice.session import checked_broadcast, cut_lineage, remove_path, scratch_path, write_table

INST, KEY = "instance", "key"


def _us(c: str = "ts"):
    return F.unix_micros(F.col(c).cast("timestamp"))


def access_count_agg(log: DataFrame) -> DataFrame:
    """Per key: number of accesses, first and last access (partial aggregation)."""
    return log.groupBy(INST, KEY).agg(
        F.count(F.lit(1)).alias("accesses"), F.min("ts").alias("first_access"), F.max("ts").alias("last_access"))


def sequence_log(log: DataFrame, checkpoint: bool = True, num_partitions: int | None = None, following: bool = False) -> DataFrame:
    """Add ``pos`` (1-based order per instance by (ts, seq)), ``prev_pos`` and
    ``prev_ts`` (previous access of the same key, NULL when cold), and with
    ``following`` ``next_ts`` (next access of the key, NULL when there is none)."""
    s = dense_position(log, [INST], ["ts", "seq"], "pos", num_partitions=num_partitions)
    s = sequence_within(s, [INST, KEY], ["pos"], ["pos", "ts"], ["ts"] if following else [], num_partitions=num_partitions)
    return cut_lineage(s) if checkpoint else s


def ttl_hits_sliding(seq_log: DataFrame, ttl_seconds: float) -> DataFrame:
    """Sliding TTL (renewed on every hit): hit iff ``ts - prev_ts < ttl``."""
    gap = _us("ts") - _us("prev_ts")
    return seq_log.withColumn("hit", F.coalesce(gap < F.lit(int(ttl_seconds * 1_000_000)), F.lit(False)))


def _hops(t: Sequence[int], i: int, ttl: int) -> list[int]:
    """Indices of the anchors from index ``i`` on: each next one is the first at or after anchor + TTL."""
    out = []
    while i < len(t):
        out.append(i)
        i = bisect_left(t, t[i] + ttl, i + 1)
    return out


def _exits(t: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of accesses leads from every possible entry: (latest entry time, time of the last anchor)
    for each group of entries with the same last anchor. An anchor before the run enters at the first access
    at or after anchor + TTL, so only the accesses of the first TTL, and the one after, are entries."""
    n = len(t)
    nxt = np.searchsorted(t, t + ttl)
    p = np.where(nxt < n, np.minimum(nxt, n - 1), np.arange(n))
    while True:  # pointer doubling inside the run
        q = p[p]
        if np.array_equal(q, p):
            break
        p = q
    entries = min(n, int(np.searchsorted(t, t[0] + ttl)) + 1)
    last = t[p[:entries]]
    ends = np.flatnonzero(np.append(last[1:] != last[:-1], True))
    return t[ends], last[ends]


def _passage(t: np.ndarray, ttl: int, most: int) -> tuple[int, int, int, list[int] | None, list[int] | None]:
    """What the other slices need of a run: first and last time, the last anchor if its first access is one, and,
    if at most ``most`` accesses can be entered at, where each leads. A denser run is asked later, once the one
    anchor that reaches it is known."""
    first, last = int(t[0]), int(t[-1])
    fresh = int(t[_hops(t, 0, ttl)[-1]])
    if first + ttl <= last and int(np.searchsorted(t, t[0] + ttl)) < most or len(t) <= most:
        entry, leave = _exits(t, ttl)
        return first, last, fresh, entry.tolist(), leave.tolist()
    return first, last, fresh, None, None


def first_at(run: np.ndarray, t: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of accesses sorted by (run, t): the index of the first one of run ``of`` at or after time ``at`` (of the next
    run's first, if there is none). Times count by their rank, so that a number holds run and time."""
    times = np.unique(t)
    width = len(times) + 1
    return np.searchsorted(run * width + np.searchsorted(times, t), of * width + np.searchsorted(times, at))


def anchors_of(run: np.ndarray, t: np.ndarray, ttl: int, entry: np.ndarray) -> np.ndarray:
    """Whether each access (sorted by run and time) is an anchor: of all runs at once, from the entries on to the
    first access of the run at or after anchor + TTL."""
    n = len(t)
    nxt = np.maximum(first_at(run, t, run, t + ttl), np.arange(1, n + 1))
    nxt = np.where((nxt < n) & (run[np.minimum(nxt, n - 1)] == run), nxt, n)
    found = np.zeros(n, dtype=bool)
    while len(entry):
        found[entry] = True
        entry = nxt[entry]
        entry = entry[entry < n]
    return found


#: Accesses of a run that other slices hear of; a run with more in one TTL is asked by its anchor instead.
MAX_ENTRIES = 1024


def _run_starts(pdf: pd.DataFrame) -> np.ndarray:
    """Where the runs of a slice sorted by (instance, key, t, seq) begin."""
    inst, key = pdf[INST].to_numpy(), pdf[KEY].to_numpy()
    return np.flatnonzero(np.append(True, (inst[1:] != inst[:-1]) | (key[1:] != key[:-1])))


def _slice_runs(pdf: pd.DataFrame) -> list[tuple[object, object, int, int]]:
    """(instance, key, from, to) of the first and the last run of a slice sorted by (instance, key, t, seq)."""
    inst, key, starts = pdf[INST].to_numpy(), pdf[KEY].to_numpy(), _run_starts(pdf)
    ends = np.append(starts[1:], len(pdf))
    return [(inst[starts[x]], key[starts[x]], int(starts[x]), int(ends[x])) for x in sorted({0, len(starts) - 1})]


def _passages(slices: DataFrame, ttls: Sequence[int], most: int) -> DataFrame:
    """Of each slice's first and last run (others begin and end inside the slice), by TTL: see ``_passage``."""
    kinds = {f.name: f.dataType.simpleString() for f in slices.schema.fields}

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([INST, KEY, "t", "seq"])
        runs, t, pid, out = _slice_runs(pdf), pdf["t"].to_numpy(), int(pdf["_pid"].iloc[0]), []
        for inst, key, i, j in {runs[0], runs[-1]}:
            for n, ttl in enumerate(ttls):
                out.append((inst, key, pid, n, *_passage(t[i:j], ttl, most)))
        return pd.DataFrame(out, columns=[INST, KEY, "pid", "n", "first", "last", "fresh", "entry", "leave"])

    return slices.groupBy("_pid").applyInPandas(
        steps, f"{INST} {kinds[INST]}, {KEY} {kinds[KEY]}, pid int, n int, first long, last long, fresh long, entry array<long>, leave array<long>")


def _carried(passages: DataFrame, ttls: Sequence[int], told: dict[tuple[int, int], int]) -> DataFrame:
    """(pid, n, anchor, open): the anchor that reaches each slice of a key that spans several, in slice order. Where
    it enters a dense run whose exit is not in ``told`` yet, the row is open and the chain stops there."""
    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, f in pdf.sort_values("pid").groupby("n"):
            anchor, ttl = None, ttls[n]
            for pid, first, last, fresh, entry, leave in zip(f["pid"], f["first"], f["last"], f["fresh"], f["entry"], f["leave"], strict=True):
                if anchor is None or anchor + ttl <= first:
                    if anchor is not None:
                        out.append((int(pid), int(n), int(anchor), False))
                    anchor = fresh
                    continue
                need = entry is None and anchor + ttl <= last and (int(pid), int(n)) not in told
                out.append((int(pid), int(n), int(anchor), need))
                if need:
                    break
                if anchor + ttl <= last:
                    anchor = told[int(pid), int(n)] if entry is None else leave[int(np.searchsorted(entry, anchor + ttl))]
        return pd.DataFrame(out, columns=["pid", "n", "anchor", "open"])

    return passages.groupBy(INST, KEY).applyInPandas(follow, "pid int, n int, anchor long, open boolean")


def _answers(ttls: Sequence[int], asked: dict[tuple[int, int], int]):
    """Of an asked slice: the last anchor of the chain that enters its first run (where a carried anchor goes)."""
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([INST, KEY, "t", "seq"])
        pid, out = int(pdf["_pid"].iloc[0]), []
        t = pdf["t"].to_numpy()[: _slice_runs(pdf)[0][3]]
        for n, ttl in enumerate(ttls):
            if (pid, n) in asked:
                out.append((pid, n, int(t[_hops(t, int(np.searchsorted(t, asked[pid, n] + ttl)), ttl)[-1]])))
        return pd.DataFrame(out, columns=["pid", "n", "anchor"])

    return answer


def fixed_ttl_anchors_multi(log: DataFrame, ttls_seconds: Sequence[float], num_partitions: int | None = None, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Fixed TTL (a hit does not renew) for several TTLs at once: returns
    ``(ttl_seconds, instance, key, seq)`` of the accesses that miss (the set /
    anchor accesses) under each TTL.

    anchor_1 = first access of a key, anchor_{k+1} = first access at or after
    anchor_k + TTL. Accesses are range sliced by (instance, key, time), so a hot
    key is spread over slices by count, and Python holds slices of a bounded number
    of rows. A slice's summary has its first and last
    time and at most ``max_entries`` exits: within one TTL a chain has one
    anchor, so a denser slice need not list its accesses. It is asked "which is
    the first access at or after x, and where does it lead" once x is known.
    Chains of all keys and TTLs advance together; a round reads only the slices
    that are asked. At last every slice walks from anchor to anchor alone,
    starting from the anchor carried to it.
    """
    seconds = [float(t) for t in ttls_seconds]
    ttls = [int(t * 1_000_000) for t in seconds]
    rows = log.select(INST, KEY, _us().alias("t"), "seq")
    order = [INST, KEY, "t", "seq"]
    s = stored_slices(rows, [INST, KEY], ["t", "seq"], held_slices(rows, num_partitions))
    kinds = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    passages = write_table(_passages(s, ttls, max_entries), "passages")
    told: dict[tuple[int, int], int] = {}  # at most one exit for each slice and TTL
    while True:
        path = scratch_path(s.sparkSession, "chains")
        _carried(passages, ttls, told).write.parquet(path)
        chain = s.sparkSession.read.parquet(path)
        asked = {(r["pid"], r["n"]): r["anchor"] for r in chain.where("open").collect()}  # at most one a slice and TTL
        if not asked:
            break

        pids = sorted({p for p, _ in asked})
        for r in s.where(F.col("_pid").isin(pids)).groupBy("_pid").applyInPandas(_answers(ttls, asked), "pid int, n int, anchor long").collect():
            told[r["pid"], r["n"]] = r["anchor"]
        remove_path(s.sparkSession, path)

    def walk(pdf: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        before = dict(zip(carried["n"].tolist(), carried["anchor"].tolist(), strict=True))  # at most one anchor a TTL
        pdf = pdf.sort_values(order)
        starts, t, seq = _run_starts(pdf), pdf["t"].to_numpy(), pdf["seq"].to_numpy()
        ends = np.append(starts[1:], len(pdf))
        run = np.repeat(np.arange(len(starts)), ends - starts)
        parts = []
        for n, ttl in enumerate(ttls):
            entry = starts
            if n in before:
                first = int(np.searchsorted(t[: ends[0]], before[n] + ttl))
                entry = np.append(first, starts[1:]) if first < ends[0] else starts[1:]
            anchors = np.flatnonzero(anchors_of(run, t, ttl, entry))
            parts.append(pd.DataFrame({"ttl_seconds": seconds[n], INST: pdf[INST].to_numpy()[anchors], KEY: pdf[KEY].to_numpy()[anchors], "seq": seq[anchors]}))
        return pd.concat(parts)

    return s.groupBy("_pid").cogroup(chain.select(F.col("pid").alias("_pid"), "n", "anchor").groupBy("_pid")).applyInPandas(
        walk, f"ttl_seconds double, {INST} {kinds[INST]}, {KEY} {kinds[KEY]}, seq {kinds['seq']}")


def fixed_ttl_anchors(log: DataFrame, ttl_seconds: float, num_partitions: int | None = None) -> DataFrame:
    """Single-TTL form of ``fixed_ttl_anchors_multi``: ``(instance, key, seq)`` of the misses."""
    return fixed_ttl_anchors_multi(log, [ttl_seconds], num_partitions=num_partitions).drop("ttl_seconds")


def ttl_hits_fixed(log: DataFrame, ttl_seconds: float) -> DataFrame:
    """Log rows with ``hit`` under the fixed-TTL rule."""
    miss = fixed_ttl_anchors(log, ttl_seconds).withColumn("_miss", F.lit(True))
    j = log.join(miss, [INST, KEY, "seq"], "left")
    return j.withColumn("hit", F.col("_miss").isNull()).drop("_miss")


# ---------------------------------------------------------------------------
# reuse distance

def _reuse_queries(s: DataFrame) -> DataFrame:
    """For every re-access i of the previous access p: the accesses up to i - 1 whose key was last seen at p or before."""
    return s.where("prev > 0").select(INST, F.col("pos").alias("id"), F.lit(0).alias("tag"), (F.col("pos") - 1).alias("x"), F.col("prev").alias("y"))


def _numbered(seq_log: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The log with ``prev`` (0 when cold), its points for ``dominance_counts``, and the longest instance."""
    s = seq_log.withColumn("prev", F.coalesce(F.col("prev_pos"), F.lit(0)).cast("long"))
    return s, s.select(INST, F.col("pos").alias("x"), F.col("prev").alias("y")), int(s.agg(F.max("pos")).first()[0] or 0)


def reuse_distance(seq_log: DataFrame, block: int = BLOCK, fanout: int = FANOUT, chunk: int = CHUNK) -> DataFrame:
    """Stack (reuse) distance of every re-access: distinct other keys of the same
    instance accessed strictly between the previous and the current access.

    d_i = #{j < i : prev_j <= p_i} - p_i (positions 1-based, prev 0 when cold): every key seen in between
    counts once, by its first access after p_i. The counts come from ``dominance_counts``, whose pandas
    groups are bounded for instances of any length.
    """
    s, points, n = _numbered(seq_log)
    found = dominance_counts(points, _reuse_queries(s), n, block, fanout, chunk).select(INST, F.col("id").alias("pos"), "n")
    q = s.where("prev > 0").join(found, [INST, "pos"])
    return q.select(INST, KEY, "seq", "ts", "pos", F.col("prev").alias("prev_pos"), (F.col("n") - F.col("prev")).alias("reuse_distance"))


def hit_rate_curve(seq_log: DataFrame, distances: DataFrame, sizes: Sequence[int],
                   by_instance: bool = False) -> DataFrame:
    """LRU hit rate for every cache size at once: hits(C) = #{d < C}."""
    g = [INST] if by_instance else []
    sizes = [int(c) for c in sizes]
    # the histogram is summed once into one row of counts (a group), a column a size; no row meets a list of sizes
    hist = distances.groupBy(*g, "reuse_distance").agg(F.count(F.lit(1)).alias("n"))
    below = hist.groupBy(*g).agg(*[F.sum(F.when(F.col("reuse_distance") < c, F.col("n")).otherwise(0)).alias(f"h{c}") for c in sizes])
    total = seq_log.groupBy(*g).agg(F.count(F.lit(1)).alias("accesses"))
    joined = total.join(below, g, "left") if g else total.crossJoin(below)  # without groups both are one row
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("cache_size"), F.coalesce(F.col(f"h{c}"), F.lit(0)).alias("hits")) for c in sizes]))
    # every size gets a row, also for an empty log (0 accesses, 0 hits)
    out = joined.select(*g, "accesses", rows.alias("r")).select(*g, F.col("r.cache_size").alias("cache_size"), "accesses", F.col("r.hits").alias("hits"))
    return out.select(*g, "cache_size", "accesses", F.col("hits").cast("long").alias("hits"),
                      round_ratio(F.col("hits") * 100, F.col("accesses"), 2).alias("hit_rate_percent"))


def sample_thresholds(log: DataFrame, max_keys: int) -> DataFrame:
    """(instance, threshold): keys with a hash below the threshold are at most ``max_keys`` of an instance.

    Every task keeps the ``max_keys`` + 1 smallest distinct hashes of an instance while it reads: once the set is full,
    its largest value is the task's threshold, and it falls with every smaller hash. The tasks' sets meet in the same
    way. The whole hash space is the threshold of an instance with fewer keys.
    """
    kind = log.schema[INST].dataType.simpleString()
    hashes = log.select(F.col(INST), hash60(F.col(KEY).cast("string")).alias("h")).where("h IS NOT NULL")

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for pdf in batches:
            for inst, f in pdf.groupby(INST, dropna=False):
                h = np.unique(f["h"].to_numpy())
                have = kept.get(inst)
                if have is not None and len(have) > max_keys:
                    h = h[h < have[-1]]
                if len(h):
                    kept[inst] = (h if have is None else np.union1d(have, h))[: max_keys + 1]
        for inst, h in kept.items():
            yield pd.DataFrame({INST: [inst] * len(h), "h": h})

    found = hashes.mapInPandas(smallest, f"{INST} {kind}, h long").distinct()
    order = Window.partitionBy(INST).orderBy("h")  # a limit: tasks pass on at most max_keys + 1 rows an instance
    top = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max_keys + 1)
    return top.groupBy(INST).agg(F.coalesce(F.max(F.when(F.col("r") == max_keys + 1, F.col("h"))), F.lit(SPACE)).alias("threshold"))


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def hit_rate_curve_sampled(log: DataFrame, sizes: Sequence[int], max_keys: int = 8192) -> DataFrame:
    """Approximate curve from at most ``max_keys`` keys of each instance, whatever their number (fixed-size spatial
    sampling): cache_size, accesses, sampled_accesses, hits, hit_rate_percent.

    Every access of a kept key is kept; the share R of the hash space below the threshold scales distances by 1 / R.
    Counts are corrected for keys that the sample holds too many or too few accesses of: an instance's hits are all its
    accesses less its sampled misses / R, at least none.
    """
    limits = checked_broadcast(write_table(sample_thresholds(log, max_keys), "limits"))  # a row an instance
    kept = log.withColumn("_h", hash60(F.col(KEY).cast("string"))).join(limits, INST).where(F.col("_h") < F.col("threshold"))
    s = sequence_log(kept.drop("_h"))
    scaled = idiv(_wide(F.col("reuse_distance")) * SPACE, _wide(F.col("threshold"))).cast("long")
    d = reuse_distance(s).join(limits, INST).withColumn("reuse_distance", scaled)
    curve = hit_rate_curve(s, d, sizes, by_instance=True).join(limits, INST)
    total = log.groupBy(INST).agg(F.count(F.lit(1)).alias("_all"))
    misses = idiv(_wide(F.col("accesses") - F.col("hits")) * SPACE, _wide(F.col("threshold")))
    rows = curve.join(total, INST).select("cache_size", F.col("_all"), F.col("accesses").alias("_sampled"), F.greatest(F.lit(0), F.col("_all") - misses).cast("long").alias("hits"))
    g = rows.groupBy("cache_size").agg(F.sum("_all").alias("accesses"), F.sum("_sampled").alias("sampled_accesses"), F.sum("hits").alias("hits"))
    return g.select("cache_size", "accesses", "sampled_accesses", "hits", round_ratio(F.col("hits") * 100, F.col("accesses"), 2).alias("hit_rate_percent"))


def curve_error(sampled: DataFrame, exact: DataFrame) -> DataFrame:
    """Sampled and exact hit rate by size, and how far they are apart (percentage points)."""
    e = exact.select("cache_size", F.col("hit_rate_percent").alias("exact_percent"))
    s = sampled.select("cache_size", "sampled_accesses", F.col("hit_rate_percent").alias("sampled_percent"))
    return s.join(e, "cache_size").withColumn("error_points", F.round(F.abs(F.col("sampled_percent") - F.col("exact_percent")), 2))


# ---------------------------------------------------------------------------
# per-configuration metrics

def last_before(seq_log: DataFrame, seconds: float, num_partitions: int | None = None) -> DataFrame:
    """(instance, pos, last_pos): the last position of the instance with a time before ``ts`` + ``seconds``.

    Every access probes its own end: the number of accesses before a probe is its place in the order of all
    accesses and probes by time, less the probes up to it, which are in the order of the positions.
    """
    t = _us("ts")
    access = seq_log.select(INST, t.alias("t"), F.lit(1).alias("access"), "pos")
    probe = seq_log.select(INST, (t + int(seconds * 1_000_000)).alias("t"), F.lit(0).alias("access"), "pos")
    ranked = dense_position(access.unionByName(probe), [INST], ["t", "access", "pos"], "place", num_partitions=num_partitions)
    return ranked.where("access = 0").select(INST, "pos", (F.col("place") - F.col("pos")).alias("last_pos"))


def access_flags(log: DataFrame, ttl_seconds: float, block: int = BLOCK, fanout: int = FANOUT, chunk: int = CHUNK) -> DataFrame:
    """Per access: reuse distance (NULL when cold), sliding-TTL hit, and ``unread_distance``: if the key does not
    come again within the TTL, the distinct other keys accessed before the entry expires (or the log ends), else NULL.

    Both counts are one run of ``dominance_counts``: the keys after access i up to position h are the
    accesses up to h whose previous access is at i or before, less i.
    """
    s, points, n = _numbered(cut_lineage(sequence_log(log, checkpoint=False, following=True)))
    ttl = int(ttl_seconds * 1_000_000)
    unread = s.where(F.col("next_ts").isNull() | (_us("next_ts") - _us("ts") >= ttl)).select(INST, "pos")
    forward = unread.join(last_before(s, ttl_seconds), [INST, "pos"]).select(
        INST, F.col("pos").alias("id"), F.lit(1).alias("tag"), F.col("last_pos").alias("x"), F.col("pos").alias("y"))
    found = dominance_counts(points, _reuse_queries(s).unionByName(forward), n, block, fanout, chunk)
    both = found.groupBy(INST, F.col("id").alias("pos")).agg(F.max(F.when(F.col("tag") == 0, F.col("n"))).alias("_back"),
                                                             F.max(F.when(F.col("tag") == 1, F.col("n"))).alias("_ahead"))
    flags = ttl_hits_sliding(s, ttl_seconds).withColumnRenamed("hit", "sliding_hit").join(both, [INST, "pos"], "left")
    return flags.select(INST, KEY, "seq", "ts", "op_ms", "is_error", (F.col("_back") - F.col("prev")).alias("reuse_distance"), "sliding_hit",
                        (F.col("_ahead") - F.col("pos")).alias("unread_distance"))


#: Policies whose hits follow recency, so that one pass serves every size.
SIZED_POLICIES = ("LRU", "TTL-LRU")


def policy_hit(policy: str, size: int):
    """Hit rule of a (policy, size) configuration over ``access_flags`` columns.

    LRU      capacity only (no expiry): reuse distance < size
    TTL-LRU  capacity + sliding TTL: both hold (exact: sliding expiry follows
             recency order, so an unexpired key is never behind an expired one)

    The policy TTL evicts the entry nearest to expiry, not the least recent one:
    it has no size rule here and is reported by TTL (``ttl_metrics``).
    """
    within = F.coalesce(F.col("reuse_distance") < size, F.lit(False))
    if policy == "LRU":
        return within
    if policy == "TTL-LRU":
        return within & F.col("sliding_hit")
    raise ValueError(policy)


def _rates(g: DataFrame) -> DataFrame:
    """Metric columns from counters."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return g.select(
        "policy", F.col("cache_size").cast("int").alias("cache_size"), F.col("ttl_hours").cast("int").alias("ttl_hours"),
        F.col("ops").cast("long").alias("total_operations"), F.col("hits").cast("long").alias("hits"), F.col("misses").cast("long").alias("misses"),
        F.col("misses").cast("long").alias("sets"), F.col("evictions").cast("long").alias("evictions"),
        round_ratio(F.col("hits") * 100, F.col("ops"), 2).alias("hit_rate_percent"),
        round_ratio(F.col("misses") * 100, F.col("ops"), 2).alias("miss_rate_percent"),
        F.when(F.col("evictions").isNotNull(), round_ratio(F.col("evictions") * 100, F.col("ops"), 2)).alias("eviction_rate_percent"),
        round_ratio(F.coalesce(F.col("hit_ms"), F.lit(0)), F.col("hits") * 100, 2).alias("avg_hit_time_ms"),
        round_ratio(F.coalesce(F.col("miss_ms"), F.lit(0)), F.col("misses") * 100, 2).alias("avg_miss_time_ms"),
        round_ratio(F.col("hits") * 100, F.col("hits") + F.col("misses"), 2).alias("cache_efficiency"),
        F.when(F.col("evictions").isNotNull(), round_ratio(F.col("hits") * 100, F.col("hits") + F.col("misses") + F.col("evictions"), 2))
        .alias("efficiency_evict"),
        F.coalesce((us("t1") - us("t0")) / 1e6, F.lit(0.0)).alias("runtime_seconds"),
    )


def access_metrics(flags: DataFrame, policies: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """Counters and rates per (policy, cache_size), one scan of the flags.

    Each instance is its own cache. ``evictions`` counts the entries pushed out
    by capacity in recency order. LRU has no expiry: per instance the accesses
    at a reuse distance of the size or more (and cold ones) less the entries
    that stay, at most the size; distinct keys are the cold accesses, so nothing
    is grouped by key. TTL-LRU: an entry is pushed out if as many distinct other
    keys as the size come before it is read again and before it expires;
    expired entries leave by themselves.
    """
    cfgs = [(p, int(c)) for p in policies for c in sizes]
    ms = F.round(F.col("op_ms") * 100).cast("long")
    cold = F.col("reuse_distance").isNull()
    aggs = [F.count(F.lit(1)).alias("ops"), F.min("ts").alias("t0"), F.max("ts").alias("t1")]
    for i, (p, c) in enumerate(cfgs):
        h = policy_hit(p, c)
        if p == "LRU":
            out = F.count_if(~policy_hit("LRU", c)) - F.least(F.lit(c), F.count_if(cold))
        else:
            # the entry that this access finds pushed out, and the one it leaves
            out = F.count_if(F.col("sliding_hit") & (F.col("reuse_distance") >= c)) + F.count_if(F.col("unread_distance") >= c)
        aggs += [out.alias(f"e{i}"), F.count_if(h).alias(f"h{i}"), F.sum(F.when(h, ms)).alias(f"hm{i}"), F.sum(F.when(~h, ms)).alias(f"mm{i}")]
    per_inst = flags.groupBy(INST).agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(c).alias("cache_size"), F.col(f"h{i}").alias("hits"), F.col(f"e{i}").alias("evictions"),
                 F.col(f"hm{i}").alias("hit_ms"), F.col(f"mm{i}").alias("miss_ms"))
        for i, (p, c) in enumerate(cfgs)]))
    long = per_inst.select("ops", "t0", "t1", rows.alias("r")).select("ops", "t0", "t1", "r.*")
    g = long.groupBy("policy", "cache_size").agg(
        F.sum("ops").alias("ops"), F.sum("hits").alias("hits"), F.sum(F.col("ops") - F.col("hits")).alias("misses"),
        F.sum("evictions").alias("evictions"),
        F.sum("hit_ms").alias("hit_ms"), F.sum("miss_ms").alias("miss_ms"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    # every configuration gets a row, also for an empty log (0 operations, 0 rates)
    grid = F.broadcast(flags.sparkSession.createDataFrame(cfgs, "policy string, cache_size int"))
    g = grid.join(g, ["policy", "cache_size"], "left").fillna(0, ["ops", "hits", "misses", "evictions"])
    return _rates(g.withColumn("ttl_hours", F.lit(None).cast("int")))


def ttl_metrics(log: DataFrame, ttl_hours: Sequence[int]) -> DataFrame:
    """The same columns for the policy TTL (expiry counted from the set, no
    capacity) per TTL: ``cache_size`` and evictions are NULL."""
    miss = fixed_ttl_anchors_multi(log, [h * 3600 for h in ttl_hours])
    ms = F.round(F.col("op_ms") * 100).cast("long")
    missed = (miss.join(log.select(INST, KEY, "seq", "op_ms"), [INST, KEY, "seq"])
              .groupBy("ttl_seconds").agg(F.count(F.lit(1)).alias("misses"), F.sum(ms).alias("miss_ms")))
    total = log.agg(F.count(F.lit(1)).alias("ops"), F.sum(ms).alias("all_ms"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    grid = log.sparkSession.createDataFrame([(float(h * 3600), h) for h in ttl_hours], "ttl_seconds double, ttl_hours int")
    g = F.broadcast(grid).join(missed, "ttl_seconds", "left").fillna(0, ["misses", "miss_ms"]).crossJoin(total)  # total is one row
    return _rates(g.select(
        F.lit("TTL").alias("policy"), F.lit(None).cast("int").alias("cache_size"), "ttl_hours", "ops",
        (F.col("ops") - F.col("misses")).alias("hits"), "misses", F.lit(None).cast("long").alias("evictions"),
        (F.coalesce("all_ms", F.lit(0)) - F.col("miss_ms")).alias("hit_ms"), "miss_ms", "t0", "t1"))


def lookup_hit(log: DataFrame, snapshot_until) -> DataFrame:
    """Look-ups against a fixed cache snapshot: the keys seen up to
    ``snapshot_until``; every later access hits iff its key is in the snapshot."""
    snap = log.filter(F.col("ts") < snapshot_until).select(INST, KEY).distinct().withColumn("_in", F.lit(True))
    later = log.filter(F.col("ts") >= snapshot_until)
    return later.join(snap, [INST, KEY], "left").withColumn("hit", F.col("_in").isNotNull()).drop("_in")


def throughput(log: DataFrame, window: str = "1 day") -> DataFrame:
    """Requests per tumbling window and per second."""
    w = F.window(F.col("ts").cast("timestamp"), window)
    g = log.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    secs = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests",
                    (F.col("requests") / secs).alias("requests_per_second"))


def error_rate(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    g = log.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors"))
    return g.select(*by, "requests", "errors",
                    round_ratio(F.col("errors") * 100, F.col("requests"), 2).alias("error_rate_percent"))
