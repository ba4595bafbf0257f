"""Shared helpers of the vector searches: clean rows, packed matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True where a vector is there and holds only finite numbers (no null, NaN or infinity)."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def nonzero(vector: Column) -> Column:
    return F.exists(vector, lambda x: x != 0)


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`vec_id, embedding` of the rows that take part: an id and a finite vector."""
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """The vectors of a list column as rows; all of one length (a table of embeddings has one width)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    if n and len(flat) % n:
        raise ValueError("vectors of different lengths in one table")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)
