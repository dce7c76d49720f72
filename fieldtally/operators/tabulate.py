"""Frequencies, cross-tabs, margins and shares.

Rows are reduced to one per combination of levels first. Totals, margins and
percentages are then taken from those counts, never from the rows again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import percent_with_count, ratio
from fieldtally.operators.packing import packed_counts
from fieldtally.operators.weights import times as weighted_times

TOTAL = "Total"


def weight_sum(weight: str | Column | None, times: str | None = None) -> Column:
    """Row count, or sum of weights where a group without any weight gives 0.

    With ``times`` a row counts as often as that column says.
    """
    if weight is None:
        return F.count("*") if times is None else F.coalesce(F.sum(times), F.lit(0))
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.coalesce(F.sum(w if times is None else weighted_times(w, times)), F.lit(0))


def frequency(df: DataFrame, keys: Sequence[str], weight: str | Column | None = None) -> DataFrame:
    """Count per combination of the keys; NULL is a level of its own."""
    return df.groupBy(*keys).agg(weight_sum(weight).alias("n"))


def with_total(freq: DataFrame, by: Sequence[str], value: str = "n", name: str = "total") -> DataFrame:
    """Add the sum of ``value`` over each ``by`` group.

    The totals are an aggregate joined back (Spark reuses the shuffle of the
    counts for it), so no task ever has to hold all levels of a group.
    """
    if not by:
        whole = freq.agg(F.sum(value).alias(name))
        return freq.withColumn(name, whole.scalar())
    totals = freq.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(F.sum(value).alias(name))
    match = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by])
    return freq.join(totals, match).drop(*[f"__{b}" for b in by])


def with_share(freq: DataFrame, by: Sequence[str], value: str = "n") -> DataFrame:
    """Add ``total`` over each ``by`` group and ``prop`` = value / total."""
    return with_total(freq, by, value).withColumn("prop", ratio(value, "total"))


def oneway(df: DataFrame, variable: str, weight: str | None = None) -> DataFrame:
    """One-way table with share of the total, NULL included: (item, n, total, prop)."""
    return with_share(frequency(df.select(F.col(variable).alias("item"), *_maybe(weight)), ["item"], weight), [])


def _maybe(weight: str | None) -> list[str]:
    return [] if weight is None else [weight]


def by_dimension(df: DataFrame, dims: Mapping[str, str] | Sequence[str], total: bool = True) -> DataFrame:
    """One row per (row, dimension) with columns ``dimension`` and ``item``.

    With ``total`` every row also counts once under dimension and item Total.
    Meant for rows already reduced by ``groupBy``.
    """
    names = dict(dims) if isinstance(dims, Mapping) else {d: d for d in dims}
    cells = [
        F.struct(F.lit(label).alias("dimension"), F.col(c).cast("string").alias("item")) for c, label in names.items()
    ]
    if total:
        cells.append(F.struct(F.lit(TOTAL).alias("dimension"), F.lit(TOTAL).alias("item")))
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.explode(F.array(*cells)).alias("__cell")).select(
        "__cell.dimension", "__cell.item", *others
    )


def descriptives(
    df: DataFrame,
    variables: Mapping[str, str] | Sequence[str],
    weight: str | None = None,
    levels: Mapping[str, int] | None = None,
) -> DataFrame:
    """One-way tables of several variables stacked, from one pass over the rows: (dimension, item, n, total, prop).

    Variables are counted in groups of few combinations (see ``packing``);
    ``levels`` states how many levels they have, by column.
    """
    names = dict(variables) if isinstance(variables, Mapping) else {v: v for v in variables}
    stated = {names[v]: [n] for v, n in (levels or {}).items() if v in names}
    counts = packed_counts(df, {label: [F.col(v)] for v, label in names.items()}, weight_sum(weight), stated)
    freq = counts.select(F.col("unit").alias("dimension"), F.col("level")[0].alias("item"), "n")
    return with_share(freq, ["dimension"])


def crosstab(df: DataFrame, row: str, col: str, weight: str | None = None, show_missing: bool = True) -> DataFrame:
    """Two-way counts, long: (row, col, n). Without ``show_missing`` NULLs of either side are left out."""
    pairs = df.select(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col"), *_maybe(weight))
    if not show_missing:
        pairs = pairs.dropna(subset=["row", "col"])
    return frequency(pairs, ["row", "col"], weight)


def with_margins(freq: DataFrame, rows: bool = True, cols: bool = True) -> DataFrame:
    """Add Total rows and / or columns to a two-way table and the share of each row.

    ``is_total`` and ``is_total_col`` tell a margin from a level that is called
    Total itself.
    """
    total = F.lit(TOTAL)

    def cell(row, col, is_total: bool, is_total_col: bool) -> Column:
        flags = (F.lit(is_total).alias("is_total"), F.lit(is_total_col).alias("is_total_col"))
        return F.struct(row.alias("row"), col.alias("col"), *flags)

    cells = [cell(F.col("row"), F.col("col"), False, False)]
    if cols:
        cells.append(cell(F.col("row"), total, False, True))
    if rows:
        cells.append(cell(total, F.col("col"), True, False))
    if rows and cols:
        cells.append(cell(total, total, True, True))
    table = (
        freq.select(F.explode(F.array(*cells)).alias("c"), "n")
        .groupBy("c.row", "c.col", "c.is_total", "c.is_total_col")
        .agg(F.sum("n").alias("n"))
    )
    # A row's total is counted once more from the plain cells, so the Total
    # column may be present or absent.
    totals = (
        freq.select(
            F.explode(
                F.array(
                    F.struct(F.col("row"), F.lit(False).alias("is_total")),
                    F.struct(total.alias("row"), F.lit(True).alias("is_total")),
                )
            ).alias("c"),
            "n",
        )
        .groupBy(F.col("c.row").alias("__row"), F.col("c.is_total").alias("__is_total"))
        .agg(F.sum("n").alias("row_total"))
    )
    match = F.col("row").eqNullSafe(F.col("__row")) & (F.col("is_total") == F.col("__is_total"))
    return table.join(totals, match).drop("__row", "__is_total").withColumn("prop", ratio("n", "row_total"))


def wide(
    table: DataFrame, row: Sequence[str], col: str, levels: Sequence[str], value: str, fill=None
) -> DataFrame:
    """Spread one value per level of ``col`` into columns, in the order given.

    The levels come from the codebook, so no extra pass is needed to find them.
    """
    out = table.groupBy(*row).pivot(col, list(levels)).agg(F.first(value))
    return out if fill is None else out.na.fill(fill, subset=list(levels))


def wide_margins(
    table: DataFrame, row: Sequence[str], levels: Sequence[str], value: str, total: str = TOTAL, fill=None
) -> DataFrame:
    """A table with margins spread into one column per named level and, last, its Total column.

    A level that is called like the margin cannot be among ``levels`` and is
    left out; the margin's column holds the margin alone.
    """
    if total in levels:
        raise ValueError(f"{total!r} names the margin")
    named = F.when(F.col("is_total_col"), total).when(F.col("col").isin(list(levels)), F.col("col"))
    spread = table.withColumn("__col", named).withColumn("__value", F.when(F.col("__col").isNotNull(), F.col(value)))
    return wide(spread, row, "__col", [*levels, total], "__value", fill)


def formatted(table: DataFrame, digits: int = 1, gap: str = " ", keep_zero: bool = False) -> DataFrame:
    """Add the printed cell ``51.1% (294)``."""
    return table.withColumn("cell", percent_with_count("prop", "n", digits, gap, keep_zero))


def cell_share(df: DataFrame, row: str, col: str, weight: str | None = None) -> DataFrame:
    """Two-way table with each cell as share of the grand total."""
    return with_share(crosstab(df, row, col, weight), [])


def conditional_counts(df: DataFrame, by: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Per group, how many rows satisfy each condition (a NULL condition does not count)."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def grand_total(table: DataFrame, sums: Sequence[str], strict: bool = False) -> DataFrame:
    """One row with the sums of the number columns.

    ``strict`` makes a total NULL as soon as one summand is NULL.
    """

    def total(c: str) -> Column:
        s = F.sum(c)
        return F.when(F.count_if(F.col(c).isNull()) == 0, s) if strict else s

    return table.agg(*[total(c).alias(c) for c in sums])
