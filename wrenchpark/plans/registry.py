"""Registered queries: one Spark builder and (where SQL can say it) one
DuckDB twin for each key of the survey's inventory.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver's tables at that scale; nothing is collected.  Parameters are fixed
here so that runs repeat (clock values from FIXTURES.md).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.testdata import DriverModel

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Spec:
    key: str
    build: Builder
    sql: str | None
    item: str            # survey inventory ids this key stands for


REGISTRY: dict[str, Spec] = {}


def register(key: str, item: str, sql: str | None = None):
    def deco(fn: Callable[[DriverModel], DataFrame]) -> Callable[[DriverModel], DataFrame]:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(DriverModel(spark, sf_dir))
        build.__name__ = f"build_{key}"
        build.__doc__ = fn.__doc__
        REGISTRY[key] = Spec(key, build, sql, item)
        return fn
    return deco


def queries() -> dict[str, Builder]:
    _load()
    return {k: s.build for k, s in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s.sql for k, s in REGISTRY.items() if s.sql}


def _load() -> None:
    # Importing the query modules fills REGISTRY.
    from . import q_changes, q_ingest, q_intake, q_listing, q_reports, q_sinks, q_stored, q_streams  # noqa: F401
