"""Choosing columns by prefix or position; all decided while the plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def prefixed(df: DataFrame, *prefixes: str) -> list[str]:
    """Names that start with any of the prefixes, in table order."""
    return [c for c in df.columns if c.startswith(prefixes)]


def without_prefixed(df: DataFrame, *prefixes: str) -> DataFrame:
    """All columns but those with a prefix."""
    return df.drop(*prefixed(df, *prefixes))


def between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last``, both included, in table order."""
    start, end = df.columns.index(first), df.columns.index(last)
    if start > end:
        raise ValueError(f"{first!r} comes after {last!r}")
    return df.columns[start : end + 1]


def move_after(df: DataFrame, names: Sequence[str], after: str) -> DataFrame:
    """Same columns, the named ones placed right after another."""
    rest = [c for c in df.columns if c not in names]
    at = rest.index(after) + 1
    return df.select(*rest[:at], *names, *rest[at:])
