"""Banner tables: one question by several demographics and in total.

The rows are first reduced to one per (demographics, question, answer). That
table, bounded by the number of answer combinations, is then laid out once per
demographic, so a banner reads its source once however many demographics it has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.tabulate import by_dimension, weight_sum, wide, with_share
from fieldtally.operators.weights import times as weighted_times

KEYS = ["question", "dimension", "item", "answer"]


def as_answers(df: DataFrame, questions: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form: one row per (interview, question) with columns question, answer."""
    if len(questions) == 1:
        (q,) = questions
        return df.select(*keep, F.lit(q).alias("question"), F.col(q).cast("string").alias("answer"))
    texts = df.select(*keep, *[F.col(q).cast("string").alias(q) for q in questions])
    return texts.unpivot(list(keep), list(questions), "question", "answer")


def side_by_side(
    df: DataFrame,
    levels: Mapping[str, Sequence[str]],
    by: Sequence[str],
    weight: str | None = None,
    times: str | None = None,
    drop_null_answer: bool = True,
) -> DataFrame:
    """(by..., question, answer, n): the answers of every question summed side by side while the rows are reduced.

    Rows are not multiplied by questions; only what is left of them, one row
    per ``by`` group, is turned long. ``levels`` states all answers of each
    question; an answer that is not among them is an error that names the
    question. An answer that no row of a group gave has no row there.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    if times:
        w = F.col(times) if weight is None else weighted_times(w, times)
    # Where no row gave the answer the sum is NULL; a row without a weight gave it and adds nothing.
    w = F.coalesce(w, F.lit(0))
    sums, cells, unstated = [], [], []
    for i, (q, stated) in enumerate(levels.items()):
        text = F.col(q).cast("string")
        for j, level in enumerate([*dict.fromkeys(stated), *([] if drop_null_answer else [None])]):
            given = text.isNull() if level is None else text == level
            sums.append(F.sum(F.when(given, w)).alias(f"s{i}_{j}"))
            cells.append(F.struct(F.lit(q).alias("question"), F.lit(level).cast("string").alias("answer"), F.col(f"s{i}_{j}").alias("n")))
        # A number, as a text here would have the rows sorted before they are summed.
        sums.append(F.count_if(~text.isin(*stated)).alias(f"u{i}"))
        message = F.concat(F.lit(f"answers to {q} that are not among its levels, rows: "), F.col(f"u{i}").cast("string"))
        unstated.append(F.when(F.col(f"u{i}") > 0, F.raise_error(message).cast("boolean")))
    sound = F.coalesce(*unstated, F.lit(True))
    reduced = df.groupBy(*by).agg(*sums).withColumn("__cells", F.when(sound, F.array(*cells)))
    return reduced.select(*by, F.explode("__cells").alias("__c")).select(*by, "__c.*").where("n IS NOT NULL")


def banner(
    df: DataFrame,
    questions: str | Sequence[str],
    dims: Sequence[str],
    weight: str | None = None,
    drop_null_answer: bool = True,
    ceil_counts: bool = False,
    total: bool = True,
    drop_null_item: bool = False,
    times: str | None = None,
    levels: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(question, dimension, item, answer, n, total, prop) for any number of questions.

    ``prop`` is the share of the answer within the item. ``ceil_counts`` rounds
    the counts up before totals and shares are taken. Where a demographic is
    NULL its rows form an item of their own, unless ``drop_null_item`` leaves
    them out of that demographic; they stay in the Total. With ``times`` a row
    counts as often as that column says, and no row is copied for it. ``levels``
    states all answers of every question, as a codebook does; the questions are
    then summed side by side and no row is multiplied by them (see
    ``side_by_side``), which is the way for reports of many questions.
    """
    qs = [questions] if isinstance(questions, str) else list(questions)
    if levels is not None:
        cells = side_by_side(df, {q: levels[q] for q in qs}, dims, weight, times, drop_null_answer)
    else:
        keep = list(dict.fromkeys([*dims, *(c for c in (weight, times) if c)]))
        answers = as_answers(df, qs, keep)
        if drop_null_answer:
            answers = answers.filter(F.col("answer").isNotNull())
        cells = answers.groupBy(*dims, "question", "answer").agg(weight_sum(weight, times).alias("n"))
    laid_out = by_dimension(cells, dims, total)
    if drop_null_item:
        laid_out = laid_out.filter(F.col("item").isNotNull())
    counts = laid_out.groupBy(*KEYS).agg(F.sum("n").alias("n"))
    if ceil_counts:
        counts = counts.withColumn("n", F.ceil("n"))
    return with_share(counts, ["question", "dimension", "item"])


def banner_wide(table: DataFrame, levels: Sequence[str], item_cell: Column, total_cell: Column) -> DataFrame:
    """Printed form: one row per item, one column per answer, blanks as ``0% (0)``.

    The cell of ordinary items and that of the Total row are given apart, as
    reports print the percentage alone for items and add the count in Total.
    """
    cell = F.when(F.col("dimension") == "Total", total_cell).otherwise(item_cell)
    spread = wide(table.withColumn("cell", cell), ["dimension", "item"], "answer", levels, "cell")
    return spread.na.fill("0% (0)", subset=list(levels))
