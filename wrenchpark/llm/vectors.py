"""Cleaning of vector columns, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Not null, and neither a null nor a non-finite component."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(v, ok), F.lit(False))


def padded(df: DataFrame, col: str, zero: Column) -> DataFrame:
    """Vectors of one length: shorter ones end in zeros."""
    span = df.agg(F.min(F.size(col)), F.max(F.size(col))).first()
    if span[0] is None or span[0] == span[1]:
        return df
    return df.withColumn(col, F.concat(F.col(col), F.array_repeat(zero, F.lit(span[1]) - F.size(col))))


def matrix(col: pa.Array, dtype=np.float64) -> np.ndarray:
    """(rows, components) of a list column whose lists have one length."""
    flat = np.asarray(col.flatten(), dtype)
    return flat.reshape(len(col), -1) if len(col) and len(flat) else np.zeros((len(col), 0), dtype)
