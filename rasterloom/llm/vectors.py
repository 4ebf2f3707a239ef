"""Usable vectors of a table: finite, not zero, of one length; equal ones as one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, v (array of double) of the vectors that take part.

    Null ids and vectors, vectors with null, NaN or infinite components, of norm 0, or of another length than the
    longest vector's take no part.
    """
    v = F.col(column).cast("array<double>")
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    fine = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = rows.filter(fine)
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    return rows.filter(F.size("v") == F.lit(longest if longest is not None else 0))


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component so that squares stay finite."""
    if not x.size:
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same whichever way round."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
