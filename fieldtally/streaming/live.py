"""Latest record per interview and running status counts from a landing folder.

Both jobs write what one batch changed into a folder of its own, so the work
of a batch grows with the batch and not with all that came before. A batch that
runs again after a failure writes the same rows once more into another folder
beside the first; readers take one complete folder per batch, so each batch
counts once and none is missing while it is written. Readers resolve the
changes to the present state, from the last compaction on. Batch numbers come
from the checkpoint, so a target folder belongs to one checkpoint: with a new
checkpoint start a new target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldtally.operators.linkage import latest_per_key
from fieldtally.sources import published

BATCH, COMPACT = "batch_id", "upto"


def landing_stream(
    spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files arriving in a folder; ``pattern`` selects file names."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def publish(df: DataFrame, target: str, number: int, kind: str = BATCH) -> None:
    """Store the rows of one batch, unless a complete folder of it is there."""
    published.publish(df, target, number, kind)


def changes(spark: SparkSession, target: str) -> DataFrame:
    """Rows of the last compaction and of all later batches, with the number of their batch.

    Folders of earlier batches are not opened.
    """
    compact = published.complete(spark, target, COMPACT)
    upto = max(compact, default=-1)
    later = {n: p for n, p in published.complete(spark, target, BATCH).items() if n > upto}
    if not compact and not later:
        raise FileNotFoundError(f"no complete batch in {target}")
    parts = [(upto, [compact[upto][0]])] if compact else []
    parts += [(n, [p[0]]) for n, p in sorted(later.items())]
    schema = spark.read.parquet(parts[0][1][0]).schema
    rows = spark.read.schema(schema).parquet(*[p for _, paths in parts for p in paths])
    folder = F.regexp_extract(F.input_file_name(), r"(?:batch_id|upto)=(\d+)/", 1).cast("bigint")
    return rows.withColumn("__batch", folder)


def compact(spark: SparkSession, target: str, present: DataFrame) -> int:
    """Publish ``present``, the state over ``changes``, as one folder; return the last batch it covers.

    Only the last compaction and the batches after it are read for it. What the
    compaction before it covered is removed then; the batches between the two
    stay, for readers that have begun with the older one.
    """
    before = max(published.complete(spark, target, COMPACT), default=-1)
    upto = max(published.complete(spark, target, BATCH), default=before)
    if upto > before:
        publish(present, target, upto, COMPACT)
        published.remove(spark, target, BATCH, before)
        published.remove(spark, target, COMPACT, before - 1)
    return upto


def keep_latest(
    stream: DataFrame, target: str, checkpoint: str, key: str, order: Sequence[str], columns: Sequence[str]
) -> StreamingQuery:
    """Reduce every batch to the last record per key and store it."""

    def store(batch: DataFrame, batch_id: int) -> None:
        publish(latest_per_key(batch, [key], order, _kept(order, columns)), target, batch_id)

    return run_batches(stream.writeStream.outputMode("append"), store, checkpoint)


def _kept(order: Sequence[str], columns: Sequence[str]) -> list[str]:
    return [*order, *[c for c in columns if c not in order]]


def read_latest(spark: SparkSession, target: str, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Present record of every key."""
    return latest_per_key(changes(spark, target), [key], order, columns)


def compact_latest(spark: SparkSession, target: str, key: str, order: Sequence[str], columns: Sequence[str]) -> int:
    """Fold the batches so far into one folder and return the last batch it covers."""
    return compact(spark, target, read_latest(spark, target, key, order, _kept(order, columns)))


def count_status(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Running number of records per key combination; each batch stores the counts it changed.

    Counts records and not what they are about: ``state.count_present`` counts each key where its latest record stands.
    """
    counts = stream.groupBy(*keys).agg(F.count("*").alias("n"))

    def store(batch: DataFrame, batch_id: int) -> None:
        publish(batch, target, batch_id)

    return run_batches(counts.writeStream.outputMode("update"), store, checkpoint)


def read_status(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """Present counts: those of the last batch that touched a key combination."""
    return changes(spark, target).groupBy(*keys).agg(F.max_by("n", "__batch").alias("n"))


def compact_status(spark: SparkSession, target: str, keys: Sequence[str]) -> int:
    """Fold the counts so far into one folder and return the last batch it covers."""
    return compact(spark, target, read_status(spark, target, keys))


def run_batches(writer, store, checkpoint: str) -> StreamingQuery:
    """Hand every batch of what is there to ``store`` (rows, number) and end."""
    return (
        writer.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
