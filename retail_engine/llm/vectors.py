"""Vectors of a table as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    of_one = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & of_one


def width(rows: DataFrame, vector: str) -> int:
    """The length of the longest vector; 0 for an empty table."""
    return rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]


def matrix(column: pa.ListArray, columns: int) -> np.ndarray:
    """Rows of doubles; a vector that is shorter ends in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == columns).all():
        return flat.reshape(len(column), columns)
    full = np.zeros((len(column), columns))
    full[np.arange(columns) < sizes[:, None]] = flat
    return full
