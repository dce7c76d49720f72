"""Latest record per key in hash buckets, and counts that follow it by retraction.

What a batch changes is stored as a log, dealt by a hash of the key into a fixed
number of buckets. Compaction folds the logs into base folders bucket by bucket
and touches only buckets that have a log; a manifest, published as a whole,
names the base folder of every bucket. So the work of a batch grows with the
batch, that of a compaction with the buckets touched, and readers see the state
before or after either of them and nothing between.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fieldtally.operators.linkage import attach_one, latest_per_key
from fieldtally.sources.published import complete, listed, publish, remove, remove_folder
from fieldtally.streaming.live import BATCH, changes, compact, run_batches

LOG, BASE = "log", "upto"
BUCKETS = 256


@dataclass(frozen=True)
class State:
    """Latest record per ``key`` under ``target``: the greatest by ``order``, with ``columns``.

    The last of ``order`` must break ties. The number of buckets is fixed with
    the first batch. NULL keys are one key. Batch numbers come from a stream's
    checkpoint, so a target belongs to one checkpoint.
    """

    spark: SparkSession
    target: str
    key: str
    order: Sequence[str]
    columns: Sequence[str]
    schema: T.StructType
    buckets: int = BUCKETS

    @classmethod
    def of(cls, like: DataFrame, target: str, key: str, order: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS) -> State:
        """State of records like those of a table or stream."""
        kept = [key, *order, *[c for c in columns if c not in order and c != key]]
        schema = T.StructType([T.StructField(c, like.schema[c].dataType) for c in kept])
        return cls(like.sparkSession, target, key, order, columns, schema, buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def reduced(self, records: DataFrame) -> DataFrame:
        """Latest record per key of some records."""
        return latest_per_key(records.select(*self.schema.names), [self.key], self.order, [c for c in self.schema.names if c != self.key])

    def append(self, records: DataFrame, number: int) -> None:
        """Store what a batch brings; a batch that is there is not stored again."""
        if number not in complete(self.spark, self.target, LOG):
            dealt = self.reduced(records).withColumn("__bucket", self.bucket()).repartition("__bucket")
            publish(dealt, self.target, number, LOG, ["__bucket"])

    def _manifest(self) -> tuple[int, dict[int, str]]:
        """Last batch the present manifest covers, and the base folder of each bucket that has one."""
        done = complete(self.spark, self.target, BASE)
        if not done:
            return -1, {}
        upto = max(done)
        return upto, {r.bucket: r.folder for r in self.spark.read.parquet(done[upto][0]).collect()}

    def _leaves(self, before: int | None, buckets: set[int] | None) -> dict[int, list[str]]:
        """Folders to read by bucket: its base, and its logs after that."""
        upto, bases = self._manifest()
        found: dict[int, list[str]] = {b: [f] for b, f in bases.items() if buckets is None or b in buckets}
        for number, folders in sorted(complete(self.spark, self.target, LOG).items()):
            if number > upto and (before is None or number < before):
                for leaf in listed(self.spark, folders[0], "__bucket=*"):
                    b = int(leaf.rpartition("=")[2])
                    if buckets is None or b in buckets:
                        found.setdefault(b, []).append(leaf)
        return found

    def _rows(self, leaves: dict[int, list[str]]) -> DataFrame:
        paths = [p for folders in leaves.values() for p in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """Present record of every key; of some buckets, or as it was before a batch."""
        kept = [self.key, *[c for c in self.columns if c != self.key]]
        return self.reduced(self._rows(self._leaves(before, buckets))).select(*kept)

    def files(self) -> list[str]:
        """Files that a reader of the present state opens."""
        return self._rows(self._leaves(None, None)).inputFiles()

    def compact(self) -> int:
        """Fold the logs into the bases of the buckets they touch and return the last batch covered.

        Base folders and logs that the manifest before needs stay until the next compaction.
        """
        upto, bases = self._manifest()
        last = max((n for n in complete(self.spark, self.target, LOG)), default=upto)
        if last <= upto:
            return upto
        touched = {b: paths for b, paths in self._leaves(None, None).items() if paths != [bases.get(b)]}
        present = self.reduced(self._rows(touched)).withColumn("__bucket", self.bucket())
        folder = f"{self.target}/base/{uuid.uuid4().hex}"
        present.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
        now = bases | {b: f"{folder}/__bucket={b}" for b in touched}
        manifest = self.spark.createDataFrame(sorted(now.items()), "bucket int, folder string").coalesce(1)
        publish(manifest, self.target, last, BASE)
        remove(self.spark, self.target, LOG, upto)
        remove(self.spark, self.target, BASE, upto - 1)
        needed = {f.split("/base/")[1] for f in [*bases.values(), *now.values()]}
        for leaf in listed(self.spark, self.target, "base/*/__bucket=*"):
            if leaf.split("/base/")[1] not in needed:
                remove_folder(self.spark, leaf)
        return last

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Keep the state of a stream's records."""
        return run_batches(stream.writeStream.outputMode("append"), self.append, checkpoint)


def retractions(state: State, records: DataFrame, number: int, by: Sequence[str]) -> DataFrame:
    """Changes (by..., n) that a batch makes to the counts of present records.

    The batch's latest records meet the state of the keys they touch, as it was
    before the batch: a key that is new adds one where it comes to stand, a key
    that moves also takes one away where it stood, and an older or equal record changes nothing.
    """
    state = replace(state, spark=records.sparkSession)  # a stream's batches have a session of their own
    new = state.reduced(records)
    # At most as many numbers as there are buckets.
    touched = {r[0] for r in new.select(state.bucket().alias("b")).distinct().collect()}
    kept = [state.key, *[c for c in state.schema.names if c != state.key]]
    old = state.reduced(state._rows(state._leaves(number, touched))).select(
        F.col(state.key), F.struct(*state.order).alias("__order"), F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(by)]).alias("__by")
    )
    met = attach_one(new.select(*kept), old, [state.key], null_safe=True)
    later = met.where(F.col("__order").isNull() | (F.struct(*state.order) > F.col("__order")))
    here = F.struct(F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(by)]).alias("at"), F.lit(1).cast("long").alias("n"))
    there = F.struct(F.col("__by").alias("at"), F.lit(-1).cast("long").alias("n"))
    both = F.when(F.col("__order").isNull(), F.array(here)).otherwise(F.array(here, there))
    moves = later.select(F.explode(both).alias("m")).select("m.at", "m.n")
    changed = moves.groupBy("at").agg(F.sum("n").alias("n")).where("n <> 0")
    return changed.select(*[F.col(f"at.b{i}").alias(c) for i, c in enumerate(by)], "n")


def count_present(stream: DataFrame, state: State, target: str, checkpoint: str, by: Sequence[str]) -> StreamingQuery:
    """Follow a stream and store, batch by batch, how the counts of present records by ``by`` change.

    The changes of a batch are stored before its records, and are computed from
    the batches before it alone: a batch that runs again finds the same.
    """

    def store(batch: DataFrame, number: int) -> None:
        if number not in complete(batch.sparkSession, target, BATCH):
            publish(retractions(state, batch, number, by), target, number, BATCH)
        state.append(batch, number)

    return run_batches(stream.writeStream.outputMode("append"), store, checkpoint)


def read_present(spark: SparkSession, target: str, by: Sequence[str]) -> DataFrame:
    """Present number of records per ``by``; combinations nobody is in any more are left out."""
    return changes(spark, target).groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0")


def compact_present(spark: SparkSession, target: str, by: Sequence[str]) -> int:
    """Fold the changes so far into one folder of counts and return the last batch it covers."""
    return compact(spark, target, read_present(spark, target, by))
