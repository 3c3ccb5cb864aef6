"""Vectors that take part in similarity work, one row for each different vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor zero, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def of_main_length(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has the most frequent length (of equally frequent ones the smallest)."""
    lengths = rows.groupBy(F.size(column).alias("length")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), "length").first()
    return rows.filter(F.size(column) == (top["length"] if top else 0))


def matrix(array: pa.Array) -> np.ndarray:
    """Equally long lists as rows of a matrix in double precision."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that tiny or huge components survive the squares."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
