"""Counts of very many variables from one pass.

One grouping over all variables reduces nothing when there are many of them:
nearly every row is a combination of its own. Here variables are packed into
groups whose combinations of levels stay under a bound, and a row is counted
once in each group. What a task can send on is the number of groups times the
bound, however many rows it reads.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Combinations of levels a group may have, and the levels a variable is taken to have where nothing is stated.
BOUND, ASSUMED = 50_000, 16


def pack(units: Mapping[str, Sequence[int]], bound: int = BOUND) -> list[list[str]]:
    """Units (by the levels of their columns) in groups whose product of levels, NULL among them, is at most ``bound``.

    Large units come first, each into the first group that has room; a unit
    over the bound is a group of its own. Ties stay in the order given.
    """
    sizes = {u: prod(n + 1 for n in levels) for u, levels in units.items()}
    groups: list[tuple[int, list[str]]] = []
    for u in sorted(sizes, key=lambda x: -sizes[x]):
        for i, (taken, names) in enumerate(groups):
            if taken * sizes[u] <= bound:
                groups[i] = (taken * sizes[u], [*names, u])
                break
        else:
            groups.append((sizes[u], [u]))
    return [names for _, names in groups]


def packed_counts(
    df: DataFrame, units: Mapping[str, Sequence[Column]], n: Column, levels: Mapping[str, Sequence[int]] | None = None, bound: int = BOUND
) -> DataFrame:
    """(unit, level, n): what ``n`` (an aggregate) is for every combination of a unit's columns, as an array of texts.

    ``levels`` states how many levels the columns of a unit have. A unit that
    has more than stated is counted just the same; only more rows are shuffled.
    ``n`` must add up over rows.
    """
    stated = {u: [ASSUMED] * len(columns) for u, columns in units.items()} | {u: x for u, x in (levels or {}).items() if u in units}
    groups = pack(stated, bound)
    texts = {u: [c.cast("string") for c in columns] for u, columns in units.items()}
    of_group = [F.struct(F.lit(g).alias("g"), F.array(*[c for u in names for c in texts[u]]).alias("v")) for g, names in enumerate(groups)]
    others = [F.col(f"`{c}`") for c in df.columns]
    cells = df.select(F.explode(F.array(*of_group)).alias("__cell"), *others).groupBy("__cell").agg(n.alias("n"))
    parts = []
    for names in groups:
        at, told = 1, []
        for u in names:
            told.append(F.struct(F.lit(u).alias("unit"), F.slice("__cell.v", at, len(texts[u])).alias("level")))
            at += len(texts[u])
        parts.append(F.array(*told))
    laid_out = cells.select(F.explode(F.get(F.array(*parts), F.col("__cell.g"))).alias("c"), "n")
    return laid_out.groupBy("c.unit", "c.level").agg(F.sum("n").alias("n"))
