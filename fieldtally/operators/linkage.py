"""Joins between interviews, rosters, frames and lookups.

Each join is written so that the side whose key may repeat a great many times is
one Spark can split when a key is skewed: the left side of a left join, or
either side of an inner join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions import not_in


def _aligned(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return right.withColumnsRenamed({k: f"__{k}" for k in keys})


def _match(keys: Sequence[str], null_safe: bool) -> Column:
    def one(k: str) -> Column:
        return F.col(k).eqNullSafe(F.col(f"__{k}")) if null_safe else F.col(k) == F.col(f"__{k}")

    return reduce(lambda a, b: a & b, [one(k) for k in keys])


def attach_one(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left join to a side with at most one row per key (weights, paradata, places)."""
    if not null_safe:
        return left.join(right, list(keys), "left")
    joined = left.join(_aligned(right, keys), _match(keys, null_safe), "left")
    return joined.drop(*[f"__{k}" for k in keys])


def attach_matching(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Inner join; skew on either side can be split."""
    if not null_safe:
        return left.join(right, list(keys))
    joined = left.join(_aligned(right, keys), _match(keys, null_safe), "inner")
    return joined.drop(*[f"__{k}" for k in keys])


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys are all there, and those a plain equality never matches."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(whole), df.filter(~whole)


def _sides(one: DataFrame, many: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key once with ``__sides``: 1 only in ``one``, 2 only in ``many``, 3 in both."""
    tagged = one.select(*keys, F.lit(1).alias("__side")).unionByName(many.select(*keys, F.lit(2).alias("__side")))
    return tagged.groupBy(*keys).agg(F.bit_or("__side").alias("__sides"))


def _filled(df: DataFrame, sides: DataFrame, lacking: int, keys: Sequence[str]) -> DataFrame:
    """``df`` and an empty row for each key it lacks."""
    return df.unionByName(sides.filter(F.col("__sides") == lacking).select(*keys), allowMissingColumns=True)


def attach_many(one: DataFrame, many: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left join to a side with any number of rows per key.

    The same rows as a plain left join. In that Spark cannot split the right
    side, so a key holding a large part of a roster would end in one task; as an
    inner join it is split. So the right side gets an empty row for each key of
    the left one that it lacks. Those are found by an aggregate over the keys
    alone, which are reduced before they are shuffled, and rows of either side
    are sorted once and not again for an anti-join.
    """
    if null_safe:
        return attach_matching(one, _filled(many, _sides(one, many, keys), 1, keys), keys, null_safe)
    (one, keyless), (many, _) = _keyed(one, keys), _keyed(many, keys)
    joined = attach_matching(one, _filled(many, _sides(one, many, keys), 1, keys), keys)
    return joined.unionByName(keyless, allowMissingColumns=True)


def counted(df: DataFrame, name: str = "times") -> DataFrame:
    """Equal rows as one with their number; a key has no more rows than it has different ones."""
    return df.groupBy(*df.columns).agg(F.count("*").alias(name))


def repeated(df: DataFrame, name: str = "times") -> DataFrame:
    """Every row as often as ``name`` says: the rows ``counted`` counted."""
    kept = [f"`{c}`" for c in df.columns if c != name]
    copies = f"explode(IF(`{name}` = 1, array(0), array_repeat(0, CAST(`{name}` AS INT)))) AS __copy"
    return df.selectExpr(*kept, copies).drop("__copy")


def full_outer(one: DataFrame, many: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of both sides, matched where the key is equal; ``many`` may repeat keys.

    An inner join of filled sides like ``attach_many``, since a full join cannot split a skewed key.
    """
    (one, keyless_one), (many, keyless_many) = _keyed(one, keys), _keyed(many, keys)
    sides = _sides(one, many, keys)
    joined = attach_matching(_filled(one, sides, 2, keys), _filled(many, sides, 1, keys), keys)
    for keyless in (keyless_one, keyless_many):
        joined = joined.unionByName(keyless, allowMissingColumns=True)
    return joined


def keep_listed(df: DataFrame, key: str, listed: DataFrame, listed_key: str | None = None) -> DataFrame:
    """Rows whose key occurs in another table."""
    other = listed.select(F.col(listed_key or key).alias(f"__{key}")).distinct()
    return df.join(other, F.col(key) == F.col(f"__{key}"), "left_semi")


def keep_matching(df: DataFrame, other: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows whose keys occur together in another table; null-safe, a missing one meets a missing one."""
    return df.join(_aligned(other.select(*keys).distinct(), keys), _match(keys, null_safe), "left_semi")


def drop_listed(df: DataFrame, key: str, listed: DataFrame | Sequence, listed_key: str | None = None) -> DataFrame:
    """Rows whose key is not listed; rows without a key stay.

    A short list of values is tested in the scan, a table is anti-joined.
    """
    if not isinstance(listed, DataFrame):
        return df.filter(not_in(key, listed))
    other = listed.select(F.col(listed_key or key).alias(f"__{key}")).distinct()
    return df.join(other, F.col(key) == F.col(f"__{key}"), "left_anti")


def heads_of(roster: DataFrame, columns: Sequence[str], relation: str = "rel", head_code: int = 1) -> DataFrame:
    """Roster rows of household heads with the wanted columns."""
    return roster.filter(F.col(relation) == head_code).select(*columns)


def earliest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """First row per key by an explicit order (the last entry must break ties).

    An aggregate and not a window: every task reduces its rows to one per key
    before the shuffle, so a key with very many rows costs no more than others.
    """
    row = F.struct(*order, *[c for c in columns if c not in order])
    first = df.groupBy(*keys).agg(F.min(row).alias("__row"))
    return first.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in columns])


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Last row per key by an explicit order; see ``earliest_per_key``."""
    row = F.struct(*order, *[c for c in columns if c not in order])
    last = df.groupBy(*keys).agg(F.max(row).alias("__row"))
    return last.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in columns])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key combination occurs more than once, with that count.

    Counting is a separate aggregate, so rows of a very frequent key are spread
    over tasks by the inner join instead of being gathered by a window. NULL
    counts as a value of a key.
    """
    repeated = df.groupBy(*keys).agg(F.count("*").alias("dupe_count")).filter("dupe_count > 1")
    return attach_matching(df, repeated, keys, null_safe=True)


def numbered(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Row number 1..n per group without sorting a whole group in one task.

    ``bucket`` must rise with ``order`` (a coarse prefix of it). Rows are numbered
    within (group, bucket); the counts of the buckets before are added to that.
    """
    # A struct equals another where NULLs meet NULLs, so windows and join share
    # one partitioning also for a group that is NULL.
    tagged = df.withColumn("__part", F.struct(*group, bucket.alias("__bucket")))
    sizes = tagged.groupBy("__part").agg(F.count("*").alias("__size"))
    before = (
        Window.partitionBy(*[f"__part.{g}" for g in group])
        .orderBy("__part.__bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    ranked = tagged.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return (
        attach_one(ranked, offsets, ["__part"])
        .withColumn(name, F.col("__rank") + F.col("__offset"))
        .drop("__rank", "__offset", "__part")
    )
