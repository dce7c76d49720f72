"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    # Recording the call site of every column costs a round trip to the JVM each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # AQE sizes the shuffles, splits skewed join partitions and turns a shuffle
    # join into a broadcast join once the measured size of a side allows it.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more shuffle after it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
}

# Table files for which a shuffle starts with one partition more, and bytes that a
# task reads of files or of merged partitions; rows of numbers take ten times that.
PARTITION_BYTES = 4 << 20
TASK_BYTES = 16 << 20


def build_session(name: str = "fieldtally", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; ``extra`` takes ``spark__sql__x="y"`` pairs."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the adaptive-execution settings to a session built elsewhere."""
    for key, value in SETTINGS.items():
        if key.startswith("spark.sql.adaptive.") and key.endswith(("enabled", "SkewedJoin")):
            spark.conf.set(key, value)
    return spark


def spread(spark: SparkSession, *paths: str) -> SparkSession:
    """Let shuffles start with partitions enough for the table files at ``paths``, where the session has fewer.

    With a fixed number, rows and memory of a task grow with the tables. Adaptive
    execution merges what turns out small. Where the files are larger than
    ``TASK_BYTES``, no more than that is merged or read from files for one task.
    The number is never lowered and that size never raised again.
    """
    size = 0
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        size += where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    now = int(spark.conf.get(initial, spark.conf.get("spark.sql.shuffle.partitions")))
    if size > now * PARTITION_BYTES:
        spark.conf.set(initial, str(-(-size // PARTITION_BYTES)))
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for most in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        if size > TASK_BYTES < as_bytes(spark.conf.get(most)):
            spark.conf.set(most, str(TASK_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only ever used by a local session with none set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return os.path.join(tempfile.gettempdir(), "fieldtally-shared")
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used; it goes when the session's JVM ends.

    All of an application's paths lie in one folder, which is made here, as
    only a folder that exists can be marked for removal.
    """
    folder = f"{shared_dir(spark)}/fieldtally-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession, path: str) -> None:
    """Remove an intermediate folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(df, label: str):
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    Used for results that several later steps need, so that a lost executor
    costs a file read and not a second pass over the source tables.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
