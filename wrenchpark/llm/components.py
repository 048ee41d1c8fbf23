"""Connected components of an edge table by alternating large and small stars.

Every round replaces edges by edges to smaller neighbours, keeps what is
connected, and ends with one star for each component.  All of it is grouping
and joining; a node with very many neighbours is pre-aggregated by the grouping
and split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _dealt(least: DataFrame) -> DataFrame:
    """Without the grouping's own partitioning, so that the join below shuffles both sides and can split a node with very many edges."""
    return least.repartition(int(least.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _dealt(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` go from larger to smaller ids."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(_dealt(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node at most, and none if larger nodes point to it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1")
    return odd.isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge to another node names; component is the smallest id.

    Null ids and loops are left out.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()).where("a <> b").distinct()
    now = stage(pairs, "components")
    while not _stars(now):
        before = now
        now = stage(_small_star(_large_star(before)), "components")
        unstage(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
