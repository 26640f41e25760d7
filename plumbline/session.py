"""Session defaults for local runs, and the shared folder for frozen tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as the session names it.

    A folder of our own is made only in local mode, as in tests: on a cluster
    every executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder, for one run's files."""
    return f"{shared_folder(spark).rstrip('/')}/plumbline-{purpose}-{uuid.uuid4().hex[:12]}"


def freeze(df: DataFrame) -> DataFrame:
    """Write a table to the checkpoint folder and go on from there.

    Lost executors do not matter afterwards, and values that depend on how the
    rows were split (partition numbers, row ids) stay as they are.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


# What a Python worker is sent at a time while a table is stored.
BATCH_BYTES = 16 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder in compressed Parquet, and go on from there.

    Like ``freeze``, but computed once and a fraction of the size; ``discard`` deletes it.
    """
    spark = df.sparkSession
    path = run_folder(spark, purpose)
    before = spark.conf.get(_BATCH_LIMIT)
    spark.conf.set(_BATCH_LIMIT, f"{BATCH_BYTES}b")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH_LIMIT, before)
    # shuffle files of finished steps go when the driver's JVM finds their plans unused
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing asks for again."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
