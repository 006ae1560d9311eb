"""Tables of vectors: usable rows, and Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is not null and holds neither nulls nor numbers that are not finite; never null."""
    held = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & held, F.lit(False))


def doubles(vector: str) -> Column:
    return F.col(vector).cast("array<double>")


def numbers(table: DataFrame, vector: str) -> Column:
    """A vector as it is when its numbers are floats, otherwise as doubles."""
    return F.col(vector) if table.schema[vector].dataType.simpleString() == "array<float>" else doubles(vector)


def width(table: DataFrame, vector: str) -> int:
    """Length of the longest vector of a table; 0 where there is none."""
    return table.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of at most ``dim`` components as rows, shorter ones with zeros at their end."""
    flat = np.asarray(column.flatten(), np.float64)
    lengths = np.asarray(pc.list_value_length(column), np.int64)
    if len(flat) == len(lengths) * dim:
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def whole(x: np.ndarray, limit: int) -> np.ndarray:
    """Whole numbers as long; beyond the limit the arithmetic of the caller would leave that range."""
    if x.size and np.abs(x).max() >= limit:
        raise ValueError(f"a component is too large: {np.abs(x).max():g}, the limit is {limit}")
    return x.astype(np.int64)
