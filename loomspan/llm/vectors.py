"""Shared handling of embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(col: str = "embedding") -> Column:
    """True where a vector can take part: no null or non-finite component, and not zero."""
    v = F.col(col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_vectors(df: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """``vec_id, v array<double>`` of the vectors that take part, of whatever dimension."""
    return df.where(usable(col)).select(F.col(id_col).alias("vec_id"), F.col(col).cast("array<double>").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; all lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
