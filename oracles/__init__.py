"""DuckDB SQL that states what each ready-made query must return."""

from oracles.statements import oracle_sql

__all__ = ["oracle_sql"]
