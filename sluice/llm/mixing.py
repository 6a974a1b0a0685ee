"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._ranks import running_total
from sluice.operators.sequence import global_dense_id
from sluice.session import write_table

#: Weights dealt to the sources in code point order (null last), again and again.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more often than this.
MOST = 3
#: Slices of virtual time; between them totals are prefix sums over at most a few more rows than this.
SLICES = 4096

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: its number ``_src``, ``source_size`` and ``target``.

    A target is the weight's share of all sizes, stopped at ``most`` times the source's size; what is
    above is shared again by weight among the others until none is above. Each round is one aggregate
    over the table of sources; nothing but its one row comes to the driver.
    """
    sizes = rows.groupBy(F.col("source").alias("_name")).agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("_last", F.col("_name").isNull().cast("int"))
    numbered = global_dense_id(sizes, ["_last", "_name"], "_src")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = write_table(numbered.withColumn("_weight", F.element_at(cycle, F.pmod(F.col("_src") - 1, F.lit(len(weights))).cast("int") + 1)), "mix-sources")
    limit = most * F.col("source_size").cast("double")
    level, again = None, 0.0
    while level != again:  # the level only rises, and each rise stops one source more
        level = again
        stopped = F.col("_weight") * F.lit(level) > limit
        r = weighted.agg(F.sum("source_size"), F.sum(F.when(stopped, limit)), F.sum(F.when(~stopped, F.col("_weight")))).first()
        if not r[2]:
            break
        again = max(level, (float(r[0] or 0) - float(r[1] or 0)) / r[2])
    return weighted.select("_name", "_src", "source_size", F.least(F.col("_weight") * F.lit(level or 0.0), limit).alias("target"))


def fair_queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7, text: str = "text",
               doc_id: str = "doc_id", source: str = "source", slices: int = SLICES) -> DataFrame:
    """How often the mix takes each row of ``docs``.

    Each source's rows are shuffled by a seeded hash and queued, up to ``most`` rounds; a copy's virtual
    finish time is the source's words up to and with it divided by the source's target. All copies are
    ranged by finish time and taken while the running total of words stays within the budget (all words).

    Returns doc_id, _text (a 64-bit hash of the text), source, size (words), source_size, target, copies
    and taken (words with repeats), one row per input row. Null texts have size 0; null sources are one
    source, the last; repeated rows are separate documents; no rows give no rows. Reruns agree.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = write_table(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(body).alias("_text"),
    ).withColumn("_uid", F.monotonically_increasing_id()), "mix-rows")
    targets = write_table(source_targets(rows, weights, most), "mix-targets")
    budget = int(targets.agg(F.sum("source_size")).first()[0] or 0)
    queued = (rows.join(targets, F.col("source").eqNullSafe(F.col("_name")), "inner")
              .withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "_text")))
    queued = running_total(queued, ["_src"], ["_hash", "doc_id", "_text"], F.col("size"), "_cumulative", ["_uid"])
    size, end = F.col("source_size").cast("double"), F.col("_cumulative").cast("double")
    copies = (queued.where((F.col("target") > 0) & (F.col("size") > 0))
              .withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
              .where(F.col("_round") * size + end - F.col("size") < F.col("target"))
              .withColumn("_finish", (F.col("_round") * size + end) / F.col("target"))
              .withColumn("_slice", F.least(F.floor(F.col("_finish") * slices), F.lit(2 * slices)).cast("int")))
    copies = write_table(copies.select("_uid", "_round", "size", "_src", "_hash", "doc_id", "_text", "_finish", "_slice"), "mix-copies")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * slices + 1 rows
    starts = copies.groupBy("_slice").agg(F.sum("size").alias("_total")).select(
        "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_slice").orderBy("_finish", "_src", "_hash", "doc_id", "_text", "_round", "_uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = (copies.join(starts, "_slice").withColumn("_total", F.col("_start") + F.sum("size").over(inside))
             .where(F.col("_total") <= F.lit(budget)).groupBy("_uid").agg(F.count(F.lit(1)).alias("copies")))
    return (rows.join(targets, F.col("source").eqNullSafe(F.col("_name")), "inner").join(taken, "_uid", "left")
            .withColumn("copies", F.coalesce("copies", F.lit(0)))
            .select("doc_id", "_text", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` (text, doc_id and source under these names), each row as
    often as the mix takes it. Rows alike in doc_id and text are taken by their total."""
    body = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").alias("_d"), body.alias("_t"), F.struct("*").alias("_row"))
    often = (fair_queue(docs, **options).groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_x"))
             .agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0"))
    joined = rows.join(often, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_x")))
    same = Window.partitionBy("_d", "_t").orderBy(F.lit(0))
    single = joined.where("_rows = 1").withColumn("_mine", F.col("_copies"))
    repeated = (joined.where("_rows > 1").withColumn("_n", F.row_number().over(same))
                .withColumn("_mine", F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_n") <= F.col("_copies") % F.col("_rows")).cast("long")).drop("_n"))
    return (single.unionByName(repeated).where("_mine > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mine")))).select("_row.*"))
