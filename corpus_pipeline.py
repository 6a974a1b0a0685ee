"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns
a DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import jaccard, mixing, packing, substring
from sluice.plans.registry import ensure_utc
from sluice.session import scratch_path, ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    from sluice.llm import langid

    ship_package(spark)
    return langid.keep_recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: word 5-grams, Jaccard similarity 0.8 or more."""
    ship_package(spark)
    return jaccard.keep_one(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start earlier too are cut out of the texts."""
    ship_package(spark)
    return substring.remove_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    ship_package(spark)
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship_package(spark)
    return packing.pack_documents(docs).drop("ids")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Neural and hash-shuffled stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a Parquet table in the checkpoint folder."""
    ensure_utc(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
