"""Writing tables, lists, logs and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions import local_time


def replace_tables(tables: Mapping[str, DataFrame]) -> None:
    """Replace each named catalog table."""
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(name)


def replace_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a parquet dataset."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited text with a header line, one file per partition."""
    df.write.mode("overwrite").options(header=True, sep=sep).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated list."""
    write_delimited(df, path, sep="\t")


def export_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Export a table or anonymised micro-data as parquet or csv."""
    if fmt == "parquet":
        replace_dataset(df, path)
    elif fmt == "csv":
        write_delimited(df, path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")


def append_entries(entries: DataFrame, path: str, zone: str = "UTC") -> None:
    """Append many audit rows (utc, user, action) at once, their time as local time of ``zone``."""
    rows = entries.select(local_time(F.col("utc"), zone).alias("timestamp"), "user", "action")
    rows.write.mode("append").parquet(path)


def append_log(spark: SparkSession, path: str, user: str, action: str, zone: str = "UTC") -> None:
    """Append one audit row (local time of ``zone``, user, action). Earlier rows stay.

    A row is a file: collect rows and use ``append_entries`` where there are many.
    """
    row = spark.range(1).select(
        F.current_timestamp().alias("utc"), F.lit(user).alias("user"), F.lit(action).alias("action")
    )
    append_entries(row, path, zone)
