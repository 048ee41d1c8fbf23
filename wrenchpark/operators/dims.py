"""Catalog (dimension) handling: size-checked broadcast joins.

Catalogs are small by nature, but nothing guarantees it, so a catalog is only
hinted for broadcast when its size is known to be under a bound: by its given
row count (seed rows), or else by the plan's own size statistics, which run no
job (files' sizes, carried through projections and aggregates as upper
estimates).  Above the bound the plain join is returned and Spark picks a shuffle join (AQE may still
turn it into a broadcast at run time when the measured size allows).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A catalog with more rows than this, or of unknown rows and more bytes, gets no hint.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 << 20


@dataclass
class Dim:
    """A dimension DataFrame with an optional known row count."""

    df: DataFrame
    rows: int | None = None

    def is_small(self, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
        if self.rows is not None:
            return self.rows <= max_rows
        size = self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(str(size)) <= BROADCAST_MAX_BYTES

    def for_join(self, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
        """The catalog, hinted for broadcast only when its size is proven small."""
        return F.broadcast(self.df) if self.is_small(max_rows) else self.df


def as_dim(df: DataFrame | Dim, rows: int | None = None) -> Dim:
    return df if isinstance(df, Dim) else Dim(df, rows)


def join_name(fact: DataFrame, dim: DataFrame | Dim, key: str, name_as: str,
              how: str = "inner", max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join ``fact.key = dim.id`` and bring ``dim.name`` in as ``name_as``."""
    d = as_dim(dim)
    right = d.for_join(max_rows).select(F.col("id").alias(f"__{name_as}_id"),
                                        F.col("name").alias(name_as))
    return (fact.join(right, fact[key] == right[f"__{name_as}_id"], how)
            .drop(f"__{name_as}_id"))
