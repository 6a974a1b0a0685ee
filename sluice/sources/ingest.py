"""Ingest: headerless CSV, defaults, idempotent and appending loads, JDBC options.

Writes go to the folder named by the caller (on a cluster: a shared path);
the helpers never assume a machine-local folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.schemas import RAW_CSV_SCHEMA

# Strings pandas' CSV reader turns into NaN by default.
PANDAS_NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                     "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# DDL defaults of the questions table (a default fills an omitted column only).
DEFAULTS = {"question_content": "", "quality_score": 0.0, "access_count": 1}
TIMESTAMP_COLS = ["created_at", "updated_at", "first_access", "last_access"]


def csv_headerless_scan(spark: SparkSession, path: str, schema: T.StructType = RAW_CSV_SCHEMA,
                        na_strings: list[str] = PANDAS_NA_STRINGS) -> DataFrame:
    """Read a headerless CSV with imposed names; quoted fields may hold commas,
    doubled quotes and newlines. Strings pandas reads as missing become NULL."""
    df = (spark.read.schema(schema)
          .option("header", False).option("quote", '"').option("escape", '"')
          .option("multiLine", True).option("mode", "PERMISSIVE")
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .csv(path))
    for f in schema.fields:
        if isinstance(f.dataType, T.StringType):
            df = df.withColumn(f.name, F.when(F.col(f.name).isin(na_strings), F.lit(None)).otherwise(F.col(f.name)))
    return df


def write_headerless_csv(df: DataFrame, path: str) -> None:
    # the CSV writer trims blanks unless told otherwise
    (df.write.mode("overwrite").option("header", False).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def fill_string_nulls(df: DataFrame) -> DataFrame:
    """``fillna('')``: only string columns take the empty string."""
    return df.na.fill("")


def column_defaults(df: DataFrame, now: Column) -> DataFrame:
    """Add the columns a load omits with their DDL defaults; present columns are
    left as they are (an explicit NULL stays NULL)."""
    out = df
    if "question_content" not in out.columns:
        out = out.withColumn("question_content", F.lit(DEFAULTS["question_content"]))
    if "llm_answer" not in out.columns:
        out = out.withColumn("llm_answer", F.lit(None).cast("string"))
    if "quality_score" not in out.columns:
        out = out.withColumn("quality_score", F.lit(DEFAULTS["quality_score"]).cast("double"))
    if "access_count" not in out.columns:
        out = out.withColumn("access_count", F.lit(DEFAULTS["access_count"]).cast("int"))
    for c in TIMESTAMP_COLS:
        if c not in out.columns:
            out = out.withColumn(c, now)
    return out


def load_row_limit(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """Keep the first ``n`` rows in an explicit order (files have no order)."""
    return df.orderBy(*order_cols).limit(n)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _data_files(spark: SparkSession, path: str) -> int | None:
    """Files that readers see below a folder (names that begin with _ or . are hidden); None if it does not exist."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    n = 0
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if not name.startswith(("_", ".")):
            n += _data_files(spark, st.getPath().toString()) if st.isDirectory() else 1
    return n


def is_empty_target(spark: SparkSession, path: str) -> bool:
    """Whether the target has no rows. A missing path and a folder without data files (what a load leaves that broke
    before its commit) are empty; any other failure is raised, so that an unreadable target is never overwritten."""
    return not _data_files(spark, path) or spark.read.parquet(path).limit(1).isEmpty()


def publish(df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path`` and move it there in one step: readers see all of it or nothing. ``path`` must
    hold no data."""
    spark = df.sparkSession
    fs, p = _hadoop(spark, path)
    staged = f"{p.getParent()}/_staged-{uuid.uuid4().hex}"  # hidden from readers
    df.write.parquet(staged)
    if fs.exists(p):
        if not is_empty_target(spark, path):
            raise FileExistsError(path)
        fs.delete(p, True)
    fs.mkdirs(p.getParent())
    if not fs.rename(_hadoop(spark, staged)[1], p):
        raise OSError(f"cannot move {staged} to {path}")


def idempotent_load(df: DataFrame, path: str) -> bool:
    """Write ``df`` only when the target holds no rows; returns whether it wrote. A load that breaks leaves the
    target empty and can be repeated."""
    if not is_empty_target(df.sparkSession, path):
        return False
    publish(df, path)
    return True


def loaded(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all published loads of ``incremental_load``; none if there is no load yet."""
    if not _data_files(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/load=*")


def incremental_load(df: DataFrame, path: str, key: str) -> int:
    """Load the rows of ``df`` whose ``key`` is not stored yet; returns their number.

    A ``left_anti`` join on the key against the published loads finds the new rows; of rows with one key the smallest
    is loaded; rows without a key are never loaded. They are published as ``path/load=<n>`` in one step, so a load
    that breaks leaves nothing behind that a reader or the next load sees, and a repeated load adds nothing.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c != key]
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_r"))
    new = one.join(loaded(spark, path, df.schema).select(key), key, "left_anti").select(
        *[F.col(key) if c == key else F.col(f"_r.`{c}`").alias(c) for c in df.columns])
    fs, p = _hadoop(spark, path)
    done = [int(st.getPath().getName()[5:]) for st in fs.listStatus(p) if st.getPath().getName().startswith("load=")] if fs.exists(p) else []
    target = f"{path}/load={max(done, default=-1) + 1}"
    publish(new, target)
    n = spark.read.schema(df.schema).parquet(target).count()
    if not n:
        fs.delete(_hadoop(spark, target)[1], True)
    return n


def batch_append_sink(df: DataFrame, path: str, files: int | None = None) -> None:
    """Append (writer tasks write in parallel). ``files`` is the number of tasks to begin with; the adaptive planner
    splits those with more than its advisory partition size, so that no task grows with the data."""
    (df.hint("rebalance", files) if files else df).write.mode("append").parquet(path)


def load_reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    s = source.agg(F.count(F.lit(1)).alias("source_rows"))
    t = target.agg(F.count(F.lit(1)).alias("target_rows"))
    return s.crossJoin(t).withColumn("match", F.col("source_rows") == F.col("target_rows"))


def jdbc_options(url: str, table: str, user: str, password: str, partition_column: str | None = None,
                 lower: int | None = None, upper: int | None = None, partitions: int | None = None,
                 batchsize: int = 1000) -> dict[str, str]:
    """Options for ``spark.read/write.format('jdbc')`` (PostgreSQL source/sink).

    Reads split on ``partition_column`` into ``partitions`` ranges; writes use
    1,000-row batches like the reference loader. No server is contacted here.
    """
    opts = {"url": url, "dbtable": table, "user": user, "password": password, "batchsize": str(batchsize),
            "driver": "org.postgresql.Driver"}
    if partition_column:
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                     "numPartitions": str(partitions or 8)})
    return opts


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def write_jdbc(df: DataFrame, options: dict[str, str], mode: str = "append") -> None:
    df.write.format("jdbc").options(**options).mode(mode).save()
