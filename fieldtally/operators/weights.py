"""Design weights, weight expansion, sample size and systematic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import ratio
from fieldtally.operators.linkage import attach_one, numbered

# Normal quantile of 95% confidence, margin of error, proportion.
Z_95 = 1.96
MARGIN = 0.08
PROPORTION = 0.5

# Copies of a row made at a time.
BLOCK = 4096


def copies(weight: str | Column) -> Column:
    """Whole number of copies a weight stands for, half-even; none for NULL."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.coalesce(F.greatest(F.bround(w, 0).cast("bigint"), F.lit(0)), F.lit(0))


def times(weight: str | Column, count: str) -> Column:
    """A weight times a row count, keeping all places of a decimal weight.

    A bigint has the width of twenty digits in a product with a decimal, which
    would cost places of the weight; eighteen digits leave room for them.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    return w * F.col(count).cast("decimal(18,0)")


def expand_by_weight(df: DataFrame, weight: str) -> DataFrame:
    """Every row as often as its rounded weight says; rows weighing 0 or nothing vanish.

    For counts and shares sum ``copies(weight)`` instead: the same result
    without a copy of any row. Copies are made in blocks, so that no row has to
    hold an array as long as its weight.
    """
    present = df.withColumn("__n", copies(weight)).filter("__n > 0")
    blocks = present.withColumn("__block", F.explode(F.expr(f"sequence(0, (__n - 1) div {BLOCK})")))
    size = F.expr(f"cast(least({BLOCK}, __n - __block * {BLOCK}) as int)")
    return blocks.withColumn("__i", F.explode(F.array_repeat(F.lit(0), size))).drop("__n", "__block", "__i")


def sample_size(
    population: str | Column,
    z: float = Z_95,
    margin: float = MARGIN,
    proportion: float = PROPORTION,
    nonresponse: float = 1.0,
) -> Column:
    """Interviews needed for a proportion with finite population correction."""
    n = F.col(population) if isinstance(population, str) else population
    variance = z * z * proportion * (1 - proportion)
    return F.lit(variance * nonresponse) / (F.lit(margin * margin) + F.lit(variance) / n.cast("double"))


def design_weights(
    frame: DataFrame, interviews: DataFrame, adults: DataFrame, stratum: str, key: str
) -> DataFrame:
    """Inverse selection probabilities of both stages per interview.

    Household weight: frame size over interviews of the stratum. Person weight:
    that times the adults of the household, one of whom was asked (``adults``
    holds one row per key with a column ``adults``). The stratum factors are
    small by nature; adaptive execution sends them to every task once it has
    measured them, or splits a stratum that holds a third of the interviews.
    """
    size = frame.groupBy(stratum).agg(F.count("*").alias("frame_n"))
    taken = interviews.groupBy(stratum).agg(F.count("*").alias("sample_n"))
    factors = attach_one(taken, size, [stratum], null_safe=True)
    factors = factors.withColumn("hh_weight", ratio("frame_n", "sample_n"))
    weighted = attach_one(interviews, factors, [stratum], null_safe=True)
    out = attach_one(weighted, adults, [key])
    return out.select(
        key, stratum, "hh_weight", "adults", (F.col("hh_weight") * F.col("adults")).alias("ind_weight")
    )


def systematic_sample(
    frame: DataFrame, stratum: str, key: str, per_stratum: int, seed: str = "frame", columns: Sequence[str] = ()
) -> DataFrame:
    """``per_stratum`` rows of each stratum at even steps through a shuffled list.

    The list is ordered by a hash of seed and key, which must tell rows apart. Its first hex digits split a
    stratum into parts of like size that are numbered apart, so a stratum with
    a third of the frame is never sorted in one task. Strata no larger than the
    sample are taken whole.
    """
    mark = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    marked = frame.select(key, stratum, *columns, mark.alias("__mark"))
    order = [F.col("__mark"), F.col(key)]
    ranked = numbered(marked, [stratum], F.substring("__mark", 1, 4), order, "position")
    sizes = frame.groupBy(stratum).agg(F.count("*").alias("stratum_n"))
    sized = attach_one(ranked, sizes, [stratum], null_safe=True)
    n = f"least({int(per_stratum)}, stratum_n)"
    step_reached = F.expr(f"(position * {n}) div stratum_n > ((position - 1) * {n}) div stratum_n")
    return sized.filter(step_reached).select(key, stratum, *columns, "position", "stratum_n")
