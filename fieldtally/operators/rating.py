"""Ratings on a 1..5 scale, one row per (interview, rated item)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import ratio
from fieldtally.operators.tabulate import by_dimension, weight_sum, wide, with_share

# The rating scale.
SCALE = [1, 2, 3, 4, 5]
SCALE_NAMES = ["One", "Two", "Three", "Four", "Five"]


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distribution(
    df: DataFrame, item: str, rate: str, dims: Sequence[str], weight: str | Column | None = None
) -> DataFrame:
    """Rating distribution of every item by demographics and in total.

    (rated, dimension, item, answer, n, total, prop). Counts are rounded up
    before totals are taken; a missing rating is part of the total.
    """
    cells = df.groupBy(F.col(item).alias("rated"), *dims, F.col(rate).alias("answer")).agg(
        weight_sum(weight).alias("n")
    )
    counts = (
        by_dimension(cells, dims)
        .groupBy("rated", "dimension", "item", "answer")
        .agg(F.ceil(F.sum("n")).alias("n"))
    )
    return with_share(counts, ["rated", "dimension", "item"])


def distribution_wide(table: DataFrame, value: str = "prop") -> DataFrame:
    """One column per point of the scale."""
    points = [str(p) for p in SCALE]
    text = table.withColumn("answer", F.col("answer").cast("string"))
    return wide(text, ["rated", "dimension", "item"], "answer", points, value)


def means(df: DataFrame, item: str, rate: str, dims: Sequence[str], weight: str | Column) -> DataFrame:
    """Weighted mean rating per item by demographics and in total: (rated, dimension, item, mean).

    Rows without a weight are left out, rows without a rating add to neither
    the sum nor the weight.
    """
    weighted = df.filter(F.col(item).isNotNull() & _column(weight).isNotNull())
    # The scale has few points: weights are summed per point, exactly, and the
    # point is multiplied with that sum. Decimals of full width would lose
    # places in the product, doubles do not.
    cells = weighted.groupBy(F.col(item).alias("rated"), *dims, F.col(rate).alias("__x")).agg(
        F.sum(weight).alias("__w")
    )
    sums = (
        by_dimension(cells, dims)
        .groupBy("rated", "dimension", "item")
        .agg(
            F.sum(F.col("__w").cast("double") * F.col("__x")).alias("wx"),
            F.sum(F.when(F.col("__x").isNotNull(), F.col("__w"))).alias("w"),
        )
    )
    return sums.select("rated", "dimension", "item", ratio("wx", "w").alias("mean"))


def weighted_mean(df: DataFrame, by: Sequence[str], value: str | Column, weight: str | Column) -> DataFrame:
    """Weighted mean per group, rows without value or weight left out."""
    x, w = _column(value), _column(weight)
    used = x.isNotNull() & w.isNotNull()
    product = w.cast("double") * x.cast("double")
    sums = df.groupBy(*by).agg(F.sum(F.when(used, product)).alias("__wx"), F.sum(F.when(used, w)).alias("__w"))
    return sums.select(*by, ratio("__wx", "__w").alias("mean"))


def likert(df: DataFrame, item: str, level: str, group: str | None = None, weight=None) -> DataFrame:
    """Share of every level per item, overall or per group, missing levels left out.

    ``weight`` stands for the number of copies of a row, so nothing is copied.
    """
    keys = [F.col(item).alias("rated"), F.col(level).alias("level")]
    by = ["rated"]
    if group:
        keys.insert(0, F.col(group).alias("group"))
        by = ["group", "rated"]
    counts = df.filter(F.col(item).isNotNull() & F.col(level).isNotNull()).groupBy(*keys).agg(
        weight_sum(weight).alias("n")
    )
    # A level with no weight at all has no copies, hence no row.
    return with_share(counts.filter("n > 0"), by)


def scale_table(df: DataFrame, item: str, rate: str) -> DataFrame:
    """Per item the count and share of each point, most positive items first.

    Positive are the points above the middle of the scale.
    """
    counts = df.filter(F.col(item).isNotNull()).groupBy(F.col(item).alias("rated")).agg(
        *[F.count_if(F.col(rate) == p).alias(name) for p, name in zip(SCALE, SCALE_NAMES, strict=True)]
    )
    total = sum((F.col(n) for n in SCALE_NAMES[1:]), F.col(SCALE_NAMES[0]))
    positive = sum((F.col(n) for n in SCALE_NAMES[4:]), F.col(SCALE_NAMES[3]))
    return counts.select(
        "rated",
        *SCALE_NAMES,
        *[ratio(n, total).alias(f"{n.lower()}_share") for n in SCALE_NAMES],
        ratio(positive, total).alias("positive_share"),
    ).orderBy(F.desc_nulls_last("positive_share"), "rated")
