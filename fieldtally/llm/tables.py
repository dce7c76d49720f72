"""Reading the corpus tables and running Arrow functions over their texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Texts go to a task in Arrow batches of about this many bytes (or one longer text), and are worked on in slices of
# about this many characters: together they bound what a task holds.
BATCH_BYTES = 4 << 20
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shielded(df: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], list[Column]]]:
    """``df`` with all columns but ``own`` under names nothing else uses, and a function that names them back.

    The function takes a table made from it and returns ``df``'s columns, in
    their order, so no column an operator makes on the way can get between.
    """
    names = {c: c if c in own else f"__kept_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), lambda made: [made[n].alias(c) for c, n in names.items()]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of bounded text; one longer text is a run of its own."""
    start = held = 0
    for i, n in enumerate(pa.compute.utf8_length(batch.column(text)).to_pylist()):
        if i > start and held + (n or 0) > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    text: str,
    begin: Callable[[], Callable[[list, pa.RecordBatch], dict]],
    added: T.StructType,
    keep: list[str],
) -> DataFrame:
    """Columns ``keep`` of ``df`` and the columns ``added``, made from whole texts.

    ``begin`` is called once per task and returns the function that turns a
    list of texts (None for null) and their rows into one list or Arrow array
    per added column. An added column replaces a kept one of its name; the rows
    show the kept ones by name.
    """
    names = {f.name.lower() for f in added.fields}
    read = [F.col(f"`{c}`") for c in keep]
    keep = [c for c in keep if c.lower() not in names]
    kept = [i for i, c in enumerate(df.select(*read).columns) if c in keep]
    source = [*read, F.col(f"`{text}`").cast("string").alias("__text")]
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    fields = list(to_arrow_schema(added))
    # Read when the plan is run, hence set and left so.
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for batch in batches:
            for part in slices(batch, "__text"):
                made = work(part.column("__text").to_pylist(), part)
                columns = [part.column(i) for i in kept]
                for field in fields:
                    values = made[field.name]
                    columns.append(values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, field.type))
                yield pa.RecordBatch.from_arrays(columns, names=keep + [f.name for f in fields])

    return df.select(*source).mapInArrow(run, schema)
