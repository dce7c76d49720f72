"""Micro-data without identifying columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

# Identifying columns of the delivered tables, and column prefixes.
IDENTIFIERS = [
    "interview__id", "building_number", "dwelling_number", "household_number", "description", "head_name",
    "language", "ed", "team", "respondent", "responsible", "result", "sssys_irnd", "has__errors",
    "interview__status", "assignment__id", "hh_final_weight", "lat", "lon", "latitude", "longitude",
]
IDENTIFIER_PREFIXES = ["hh_gps", "gps", "name", "visits"]


def _plain(column: str) -> str:
    """A column's name without case and underscores, as deliveries differ in both."""
    return column.replace("_", "").lower()


def identifying(
    columns: Sequence[str],
    identifiers: Sequence[str] = tuple(IDENTIFIERS),
    prefixes: Sequence[str] = tuple(IDENTIFIER_PREFIXES),
) -> list[str]:
    """Those of the columns that identify somebody, whatever their case and underscores."""
    names, starts = {_plain(i) for i in identifiers}, tuple(_plain(p) for p in prefixes)
    return [c for c in columns if _plain(c) in names or _plain(c).startswith(starts)]


def anonymise(
    df: DataFrame,
    allowed: Sequence[str],
    renamed: Mapping[str, str] | None = None,
    identifiers: Sequence[str] = tuple(IDENTIFIERS),
    prefixes: Sequence[str] = tuple(IDENTIFIER_PREFIXES),
) -> DataFrame:
    """Only the allowed columns, in that order. An identifier among them is an error."""
    leaked = identifying(allowed, identifiers, prefixes)
    if leaked:
        raise ValueError(f"identifying columns may not be exported: {leaked}")
    return df.select(*allowed).withColumnsRenamed(dict(renamed or {}))
