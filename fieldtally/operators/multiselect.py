"""Questions with several answers, held as one 0/1/NULL column per option.

Options are summed side by side while the rows are reduced; only the reduced
table is turned long. The source is read once and never multiplied by options.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import as_number, collapse, level_index, ratio
from fieldtally.operators.tabulate import by_dimension, wide, with_total
from fieldtally.operators.weights import times as weighted_times

BASES = ("answered", "all", "mentions")


def option_columns(df: DataFrame, prefix: str) -> list[str]:
    """The option columns ``prefix__<code>`` (not the text column ``prefix_1``)."""
    pattern = re.compile(re.escape(prefix) + r"__\d+")
    return [c for c in df.columns if pattern.fullmatch(c)]


def option_sums(
    df: DataFrame, by: Sequence[str], options: Sequence[str], weight: str | None = None, times: str | None = None
) -> DataFrame:
    """Per ``by`` group and option: selected, answered and all weight (or rows).

    Long result (by..., option, selected, answered, everyone). An option is
    selected when it holds 1. A weight that is NULL adds to none of them. With
    ``times`` a row counts as often as that column says.
    """
    w = F.col(weight) if weight else F.lit(1)
    if times:
        w = weighted_times(w, times) if weight else F.col(times)
    types = dict(df.dtypes)

    def chosen(c: str) -> Column:
        return as_number(c, "int") if types[c] == "string" else F.col(c)

    sums = []
    for i, c in enumerate(options):
        sums.append(F.coalesce(F.sum(F.when(chosen(c) == 1, w)), F.lit(0)).alias(f"s{i}"))
        sums.append(F.coalesce(F.sum(F.when(chosen(c).isNotNull(), w)), F.lit(0)).alias(f"a{i}"))
    cells = df.groupBy(*by).agg(*sums, F.coalesce(F.sum(w), F.lit(0)).alias("everyone"))
    per_option = [
        F.struct(F.lit(c).alias("option"), F.col(f"s{i}").alias("selected"), F.col(f"a{i}").alias("answered"))
        for i, c in enumerate(options)
    ]
    return cells.select(*by, "everyone", F.explode(F.array(*per_option)).alias("__o")).select(
        *by, "__o.option", "__o.selected", "__o.answered", "everyone"
    )


def _shares(sums: DataFrame, group: Sequence[str], base: str, ceil_counts: bool) -> DataFrame:
    if base not in BASES:
        raise ValueError(f"base must be one of {BASES}")
    if base == "mentions":
        out = with_total(sums.select(*group, "option", "selected"), group, "selected", "total")
    else:
        whole = {"answered": "answered", "all": "everyone"}[base]
        out = sums.select(*group, "option", "selected", F.col(whole).alias("total"))
    if ceil_counts:
        out = out.withColumns({c: F.ceil(c) for c in ("selected", "total")})
    return out.withColumn("prop", ratio("selected", "total"))


def banner_multi(
    df: DataFrame,
    options: Sequence[str],
    dims: Sequence[str],
    weight: str | None = None,
    base: str = "answered",
    ceil_counts: bool = True,
    total: bool = True,
    times: str | None = None,
) -> DataFrame:
    """(dimension, item, option, selected, total, prop) for the options of one question.

    The share is taken of those who answered, of all respondents, or of all
    options ticked (``base`` answered / all / mentions). With ``times`` a row
    counts as often as that column says.
    """
    cells = option_sums(df, dims, options, weight, times)
    sums = (
        by_dimension(cells, dims, total)
        .groupBy("dimension", "item", "option")
        .agg(*[F.sum(c).alias(c) for c in ("selected", "answered", "everyone")])
    )
    return _shares(sums, ["dimension", "item"], base, ceil_counts)


def multi_by_region(
    df: DataFrame, options: Sequence[str], by: Sequence[str], overall: str | None = None
) -> DataFrame:
    """Share of all respondents choosing each option, by region and, if named, overall."""
    cells = option_sums(df, by, options)
    if overall:
        whole = F.struct(*[F.lit(overall).alias(b) for b in by], F.lit(True).alias("is_overall"))
        each = F.struct(*by, F.lit(False).alias("is_overall"))
        spread = cells.select(F.explode(F.array(each, whole)).alias("g"), "option", "selected", "everyone")
        keys = [F.col(f"g.{b}").alias(b) for b in [*by, "is_overall"]]
        cells = spread.groupBy(*keys, "option").agg(
            F.sum("selected").alias("selected"), F.sum("everyone").alias("everyone")
        )
    keep = [*by, "is_overall"] if overall else list(by)
    return cells.select(
        *keep,
        "option",
        F.col("selected").alias("n"),
        F.col("everyone").alias("total"),
        ratio("selected", "everyone").alias("prop"),
    )


def label_options(table: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Add the name of each option and its place in the order given."""
    return table.withColumns(
        {
            "label": collapse("option", {new: [old] for old, new in labels.items()}),
            "label_order": level_index("option", list(labels)),
        }
    )


def mentions(df: DataFrame, options: Sequence[str], by: str) -> DataFrame:
    """How often each option was ticked per group, and over all options: (by, option, is_total, n)."""
    ticked = option_sums(df, [by], options).filter("selected > 0").select(by, "option", F.col("selected").alias("n"))
    both = F.array(
        F.struct(F.col("option"), F.lit(False).alias("is_total")), F.struct(F.lit("Total").alias("option"), F.lit(True).alias("is_total"))
    )
    spread = ticked.select(by, F.explode(both).alias("o"), "n")
    return spread.groupBy(by, "o.option", "o.is_total").agg(F.sum("n").alias("n"))


def printed_by_region(table: DataFrame, by: Sequence[str], options: Sequence[str]) -> DataFrame:
    """Shares of ``multi_by_region`` as printed, one column per option: ``51.1% (294)``.

    The share is rounded to three places before it becomes a percentage.
    """
    percent = (F.bround("prop", 3) * 100).cast("decimal(9,1)").cast("string")
    cell = F.concat(F.regexp_replace(percent, r"\.0$", ""), F.lit("% ("), F.col("n").cast("string"), F.lit(")"))
    return wide(table.withColumn("cell", cell), by, "option", options, "cell")


def item_shares(
    df: DataFrame, options: Sequence[str], labels: Mapping[str, str], weight: str | Column | None = None
) -> DataFrame:
    """Yes / No share per option among the rows that have the first option answered.

    A row replicated by its weight is the same as a row counted with it, so
    the weight is summed and no row is copied.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    w = F.lit(1) if w is None else w
    asked = df.filter(F.col(options[0]).isNotNull())
    yes = [F.coalesce(F.sum(F.when(F.col(c) == 1, w)), F.lit(0)).alias(c) for c in options]
    totals = asked.agg(*yes, F.coalesce(F.sum(w), F.lit(0)).alias("__all"))
    cells = []
    for c in options:
        cells.append(F.struct(F.lit(c).alias("item"), F.lit("Yes").alias("value"), F.col(c).alias("n")))
        cells.append(F.struct(F.lit(c).alias("item"), F.lit("No").alias("value"), (F.col("__all") - F.col(c)).alias("n")))
    long = totals.select(F.explode(F.array(*cells)).alias("c"), "__all").filter("c.n > 0")
    return long.select(
        collapse("c.item", {new: [old] for old, new in labels.items()}).alias("item"),
        F.col("c.value").alias("value"),
        F.col("c.n").alias("n"),
        ratio("c.n", "__all").alias("prop"),
    )
