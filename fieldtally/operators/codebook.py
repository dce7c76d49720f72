"""Codebooks: code, label and order of the levels of every coded variable.

A codebook is a table (variable, code, label, level_order). It comes with the
questionnaire, so it grows with the number of questions and not with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions.recode import first_match
from fieldtally.operators.linkage import attach_one
from fieldtally.operators.packing import packed_counts

SCHEMA = T.StructType(
    [
        T.StructField("variable", T.StringType(), False),
        T.StructField("code", T.LongType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("level_order", T.IntegerType(), False),
    ]
)


def codebook(spark: SparkSession, levels: Mapping[str, Mapping[int, str]]) -> DataFrame:
    """Codebook table from ``{variable: {code: label}}``, order as written."""
    rows = [
        (variable, code, label, i)
        for variable, labels in levels.items()
        for i, (code, label) in enumerate(labels.items(), start=1)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def label_of(code: Column | str, labels: Mapping[int, str]) -> Column:
    """Label of a code as one CASE expression; unknown codes become NULL."""
    c = F.col(code) if isinstance(code, str) else code
    return first_match([(c == k, v) for k, v in labels.items()])


def labelled(df: DataFrame, levels: Mapping[str, Mapping[int, str]]) -> DataFrame:
    """Replace the codes of the named columns by their labels.

    For the handful of levels a question has; a variable with very many codes
    belongs in a codebook table and ``decode``.
    """
    return df.withColumns({v: label_of(v, labels) for v, labels in levels.items()})


def decode(df: DataFrame, book: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Add ``<variable>_label`` and ``<variable>_order`` from a codebook table, whatever the number of variables.

    The codebook is folded into one row with a map of levels per variable, and
    the rows look their codes up in it: no variable costs a join. It is read
    once, as it grows with the questionnaire and not with the data; a map is
    searched from its start, so a variable with thousands of codes is better
    joined. A code listed twice for a variable is an error when the table is
    used. Missing and unknown codes have neither label nor order.
    """
    twice = F.raise_error(F.concat(F.lit("code listed twice in the codebook: "), F.col("code").cast("string")))
    levels = book.filter(F.col("variable").isin(list(variables))).groupBy("variable", "code").agg(
        F.count("*").alias("__n"), F.max("label").alias("label"), F.max("level_order").alias("level_order")
    )
    label = F.when(F.col("__n") > 1, twice.cast("string")).otherwise(F.col("label"))
    entry = F.struct(F.col("code").cast("bigint"), F.struct(label.alias("label"), "level_order"))
    maps = [
        F.map_from_entries(F.collect_list(F.when(F.col("variable") == v, entry))).alias(f"v{i}") for i, v in enumerate(variables)
    ]
    folded = levels.agg(*maps).select(F.struct(*[f"v{i}" for i in range(len(variables))]).alias("book"))
    found = df.withColumn("__book", folded.scalar())
    for i, v in enumerate(variables):
        at = F.element_at(F.col(f"__book.v{i}"), F.col(v).cast("bigint"))
        found = found.withColumns({f"{v}_label": at["label"], f"{v}_order": at["level_order"]})
    return found.drop("__book")


def observed_levels(
    df: DataFrame, book: DataFrame, variables: Sequence[str], levels: Mapping[str, int] | None = None
) -> DataFrame:
    """The codebook without levels that no row holds, for all variables in one pass.

    Variables are reduced in groups of few combinations (see ``packing``);
    ``levels`` states how many levels they have.
    """
    units = {v: [F.col(v).cast("bigint")] for v in variables}
    seen = packed_counts(df, units, F.count("*"), {v: [n] for v, n in (levels or {}).items()})
    codes = seen.select(F.col("unit").alias("__variable"), F.col("level")[0].cast("bigint").alias("__code"))
    return book.join(
        codes, (F.col("variable") == F.col("__variable")) & (F.col("code") == F.col("__code")), "left_semi"
    )


def with_codebook_order(table: DataFrame, book: DataFrame, variable: str, label: str) -> DataFrame:
    """Add ``level_order`` to a table of labels; NULL for labels the codebook lacks."""
    levels = book.filter(F.col("variable") == variable).select(F.col("label").alias(label), "level_order")
    return attach_one(table, levels, [label])
