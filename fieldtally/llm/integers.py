"""Vectors as whole numbers: scaling in Spark, exact products and distances in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Whether a vector is there, without a null or non-finite component."""
    value = F.col(f"`{column}`").cast("array<double>")
    return F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(column: str, scale: int) -> Column:
    """floor(scale * x) of every component, in double precision.

    Numbers so large that a product or squared distance of two vectors of this
    length could pass 2**60 (from 2**26 on for 64 components) are held at that end.
    """
    value = F.col(f"`{column}`").cast("array<double>")
    most = F.floor(F.sqrt(F.lit(2.0**60) / F.greatest(F.size(value), F.lit(1))) / 2)
    held = F.transform(value, lambda x: F.greatest(-most, F.least(most, F.floor(x * F.lit(float(scale))))))
    return held.cast("array<int>")


def matrix(column, width: int) -> np.ndarray:
    """A column of whole-number lists as rows of ``width`` 64-bit numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of a and b, exact: in doubles where none can pass 2**53, else in integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between the rows of a and b."""
    return (a * a).sum(axis=1)[:, None] - 2 * products(a, b) + (b * b).sum(axis=1)[None, :]


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as an Arrow column of lists."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()).cast(kind))
