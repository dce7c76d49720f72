"""Reading survey inputs. Schemas are given, never inferred from the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions import as_number
from fieldtally.sources.schemas import ASSIGNMENTS, FRAME, WEIGHTS

def read_dataset(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Parquet dataset; with ``columns`` the scan reads those only."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if columns is None else df.select(*columns)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Delimited text with a header line. A malformed line is an error, not a silent NULL."""
    return spark.read.schema(schema).options(header=True, sep=sep, mode="FAILFAST").csv(path)


def read_weights(spark: SparkSession, path: str, schema: T.StructType = WEIGHTS) -> DataFrame:
    """Design weights per interview from CSV, held as decimals so that sums are exact."""
    return read_delimited(spark, path, schema)


def read_assignments(spark: SparkSession, path: str, schema: T.StructType = ASSIGNMENTS) -> DataFrame:
    """Tab-separated assignment list."""
    return read_delimited(spark, path, schema, sep="\t")


def as_frame(raw: DataFrame, columns: Sequence[str] = tuple(FRAME.names), numbers: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Sample frame from a delivered table: wanted columns, coordinates as numbers."""
    return raw.select(*columns).withColumns({c: as_number(F.col(c).cast("string")) for c in numbers})


def read_table(
    spark: SparkSession, name: str, columns: Sequence[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Catalog table; columns and limit reach the scan."""
    df = spark.read.table(name)
    df = df if columns is None else df.select(*columns)
    return df if limit is None else df.limit(limit)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    columns: Sequence[str] | None = None,
    split: tuple[str, int, int, int] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Database table; columns and limit are pushed to the database.

    ``split`` = (number column, low, high, parts) reads it in parallel; without
    it one task reads the whole table, so name it for any large one. ``table``
    may also be a query in brackets with an alias.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if split:
        column, low, high, parts = split
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    df = reader.load()
    df = df if columns is None else df.select(*columns)
    return df if limit is None else df.limit(limit)
