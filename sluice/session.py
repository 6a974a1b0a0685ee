"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators assume: UTC clock (the reference pins UTC), AQE for
# runtime re-planning and skew splitting, Arrow for the few pandas stages.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of intermediate results are removed once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "sluice") -> SparkSession:
    """Build (or reuse) a session with the base configuration.

    Under spark-submit the master, memory and shuffle partitions are the
    cluster's. Only a local session (no master given anywhere) gets
    ``local[$BENCH_CPUS or *]``, 16 GB and as many shuffle partitions as asked
    for (8).
    """
    from pyspark import SparkConf

    builder = SparkSession.builder.appName(app)
    given = master or SparkConf().get("spark.master", None) or os.environ.get("SPARK_MASTER")
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if not given or str(given).startswith("local"):
        builder = builder.master(given or f"local[{os.environ.get('BENCH_CPUS', '*')}]")
        builder = builder.config("spark.driver.memory", os.environ.get("SLUICE_DRIVER_MEMORY", "16g"))
        shuffle_partitions = shuffle_partitions or 8
    elif master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sluice`` importable in the Python workers (pandas groups and
    stateful streams unpickle functions from it): zip the package once per
    Spark application and add it with ``addPyFile``, Spark's own code
    distribution path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="sluice-pyfiles-"), "sluice.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder used to cut lineage.

    Uses ``spark.checkpoint.dir`` (or an already-set checkpoint dir) from the
    session. Only a local-mode session without one gets a private temp folder;
    a cluster session without a shared folder is a configuration error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running sluice jobs on a cluster")
    local = tempfile.mkdtemp(prefix="sluice-ckpt-")
    sc.setCheckpointDir(local)
    return local


_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder under the shared checkpoint folder. It goes, with all intermediate tables, when
    the application ends (the file system's delete on exit)."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = f"{checkpoint_dir(spark).rstrip('/')}/sluice-{uuid.uuid4().hex}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _ROOTS[app] = root
    return _ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the application's scratch folder (for sinks and round trips)."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` into the shared checkpoint folder: later
    stages read the saved partitions (no recomputation of the upstream plan,
    survives executor loss, keeps the physical partitioning)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as a parquet table in the scratch folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def checked_broadcast(stored: DataFrame, most: int = 100_000) -> DataFrame:
    """A stored table with a broadcast hint if it has at most ``most`` rows, as it is otherwise."""
    return F.broadcast(stored) if stored.count() <= most else stored


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, through the file system it lives in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
