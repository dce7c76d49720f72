"""Folders that are there as a whole or not at all, and tables replaced together.

A folder is published by the marker its writer puts last (``_SUCCESS``), under a
kind and a number: ``target/kind=number/unique name``. Readers take the first
complete folder of a number by name, so a step that runs again adds nothing. A
set of tables is replaced by writing each into a folder of its own and then
publishing a manifest that names them all: until it is there readers see the
old set, from then on the new one, and never some of each.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "version"


def _files(spark: SparkSession, target: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, target: str, pattern: str) -> list[str]:
    """Paths under ``target`` that a pattern fits, in order."""
    root, files = _files(spark, target)
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, pattern)) or []
    return sorted(s.getPath().toString() for s in found)


def complete(spark: SparkSession, target: str, kind: str) -> dict[int, list[str]]:
    """Folders of ``target`` that were written to the end, by their number."""
    found: dict[int, list[str]] = {}
    for marker in listed(spark, target, f"{kind}=*/*/_SUCCESS"):
        folder = marker.rpartition("/")[0]
        number = int(folder.split("/")[-2].split("=")[1])
        found.setdefault(number, []).append(folder)
    return found


def publish(df: DataFrame, target: str, number: int, kind: str, partition_by: Sequence[str] = ()) -> None:
    """Store rows under a number, unless a complete folder of it is there."""
    if number not in complete(df.sparkSession, target, kind):
        df.write.partitionBy(*partition_by).parquet(f"{target}/{kind}={number}/{uuid.uuid4().hex}")


def remove(spark: SparkSession, target: str, kind: str, last: int) -> None:
    """Remove the folders of a kind up to a number."""
    for path in listed(spark, target, f"{kind}=*"):
        if int(path.rpartition("=")[2]) <= last:
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)


def replace_together(spark: SparkSession, target: str, tables: Mapping[str, DataFrame], keep: int = 2) -> int:
    """Replace a set of tables under ``target`` at once and return the number of the new version.

    Tables that are not given stay as they were, in the new version too. The
    last ``keep`` versions stay readable, so a reader that has begun with the
    one before is not disturbed; older ones are removed. A failure before the
    end leaves the present version as it is. Versions are made by one writer at a
    time: where two publish the same number, the first by name holds and the other is told.
    """
    versions = complete(spark, target, MANIFEST)
    number = max(versions, default=0) + 1
    folders = _folders(spark, versions[number - 1][0]) if number - 1 in versions else {}
    for name, df in tables.items():
        folders[name] = f"{target}/data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(folders[name])
    own = f"{target}/{MANIFEST}={number}/{uuid.uuid4().hex}"
    spark.createDataFrame(sorted(folders.items()), "name string, folder string").coalesce(1).write.parquet(own)
    first = complete(spark, target, MANIFEST)[number][0]
    if first.rpartition("/")[2] != own.rpartition("/")[2]:
        raise RuntimeError(f"version {number} of {target} was published by another writer")
    _forget(spark, target, number - keep)
    return number


def _folders(spark: SparkSession, manifest: str) -> dict[str, str]:
    return {r.name: r.folder for r in spark.read.parquet(manifest).collect()}


def _forget(spark: SparkSession, target: str, last: int) -> None:
    """Remove versions up to a number and the data that no later one names."""
    remove(spark, target, MANIFEST, last)
    named = {f.rpartition("/")[2] for paths in complete(spark, target, MANIFEST).values() for f in _folders(spark, paths[0]).values()}
    for path in listed(spark, target, "data/*"):
        if path.rpartition("/")[2] not in named:
            remove_folder(spark, path)


def read_together(spark: SparkSession, target: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one version, the present one by default, all as they were published together."""
    versions = complete(spark, target, MANIFEST)
    if not versions:
        raise FileNotFoundError(f"nothing is published in {target}")
    folders = _folders(spark, versions[max(versions) if version is None else version][0])
    return {name: spark.read.parquet(folder) for name, folder in folders.items()}
