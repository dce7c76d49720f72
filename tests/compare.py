"""Compare a query with its SQL statement on one folder of tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str:
    """Empty when rows, names and types agree, else what differs."""
    result = con.sql(sql)
    names, types = list(result.columns), [str(t) for t in result.types]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_types = dict(df.dtypes)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in zip(names, types, strict=True):
        if kinds.get(spark_types[name]) != kind:
            return f"type of {name}: {spark_types[name]} != {kind}"
    got, want = _bag(df.columns, [tuple(r) for r in df.collect()]), _bag(names, result.fetchall())
    if got == want:
        return ""
    extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
    return f"{sum(got.values())} rows != {sum(want.values())}; only here {extra}; only there {missing}"
