"""Operator 7: embedding near-duplicates by an exact metric range join.

Vectors are scaled to length 1; cosine >= c is then a distance of at most
eps = sqrt(2 - 2c).  Equal vectors form one class first.

1. Pivots, a bounded sample, cut the space into cells; a class is an inner
   member of the cell of its nearest pivot.
2. It is an outer member of every other cell that may hold a neighbour.  By the
   triangle inequality that needs d(x, p_j) <= d(x, p_i) + 2 eps and
   d(x, p_j) <= radius_j + eps; the bisector of p_i and p_j must also lie within
   eps, which is (d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j)).
3. Cells join on their own: each inner member meets all members of its cell, so
   its links are counted completely there.  Large cells are cut into blocks of
   inner members times blocks of all members.
4. A block returns counts, and a star for each group of linked members instead
   of all pairs.  Connected components of the stars are those of the links.

Cases: null, zero or empty vectors, and null or non-finite components, link
with nothing; a null id links with nothing and has a null component; rows that
share an id are one node; shorter vectors count as ending in zeros; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, stage, table
from .components import components
from .forest import Forest
from .vectors import finite, matrix, padded

ROWS_PER_PIVOT = 4000
MOST_PIVOTS = 4096
INNER_BLOCK = 4000
OTHER_BLOCK = 20_000
#: Rounding of dot products is far below this; pairs within it of the bound are decided by the plain formula.
SLACK = 1e-9
TILE = 1024


def unit(x: np.ndarray) -> np.ndarray:
    # Divide by the largest component first: squares of very large or small values would overflow or vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _homes(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = unit(matrix(b.column(2)))
                dots = u @ pivots.T
                cell = dots.argmax(axis=1)
                dist = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(u)), cell]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(dist)],
                                                 names=["id", "n", "v", "cell", "dist"])
    return run


def link_block(ids: np.ndarray, v: np.ndarray, n: np.ndarray, others: np.ndarray, w: np.ndarray, m: np.ndarray,
               cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weight of the links of inner members (ids, v, n) among the others, and the smallest id linked with each here.

    Others that are linked follow the inner members, with weight 0, so that the stars keep every link.
    """
    every, where = np.unique(np.concatenate([ids, others]), return_inverse=True)
    left, right = where[:len(ids)], where[len(ids):]
    forest, links = Forest(len(every)), np.zeros(len(ids), np.int64)
    a, b = unit(v), unit(w)
    for i in range(0, len(ids), TILE):
        for j in range(0, len(others), TILE):
            dots = a[i:i + TILE] @ b[j:j + TILE].T
            linked = dots >= cosine + SLACK
            r, c = np.nonzero((dots >= cosine - SLACK) & ~linked)
            if len(r):
                x, y = v[i + r], w[j + c]
                plain = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                linked[r, c] = plain >= cosine
            linked &= left[i:i + TILE, None] != right[None, j:j + TILE]
            links[i:i + TILE] += linked @ m[j:j + TILE]
            r, c = np.nonzero(linked)
            forest.union(left[i + r], right[j + c])
    root = forest.roots()
    more = np.setdiff1d(np.flatnonzero(root != np.arange(len(root))), left)
    at = np.concatenate([left, more])
    return every[at], np.concatenate([links, np.zeros(len(more), np.int64)]), every[root[at]]


def near_duplicates(rows: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = rows.sparkSession
    arrow_batches(spark)
    base = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    good = F.col("id").isNotNull() & finite(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    base = stage(base.select("id", F.when(good, F.transform("v", lambda x: x.cast("double"))).alias("v"))
                 .withColumn("key", F.md5(F.col("v").cast("string"))), "range-rows")
    equal = padded(base.where("v is not null"), "v", F.lit(0.0)).groupBy("key").agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.min("v").alias("v"))
    classes = stage(equal, "range-classes")
    size = classes.count()
    if not size:
        return base.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    n_pivots = max(1, min(MOST_PIVOTS, size // ROWS_PER_PIVOT))
    chosen = classes.orderBy(F.xxhash64("key"), "key").limit(n_pivots).select("v").collect()
    pivots = unit(np.array([r.v for r in chosen], np.float64))
    homes = stage(classes.select("id", "n", "v").mapInArrow(_homes(pivots), "id long, n long, v array<double>, cell int, dist double"), "range-homes")
    radius = np.full(n_pivots, -1.0)
    inner = np.zeros(n_pivots, np.int64)
    for r in homes.groupBy("cell").agg(F.max("dist").alias("r"), F.count("*").alias("n")).collect():
        radius[r.cell], inner[r.cell] = r.r, r.n
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    # An upper bound of a cell's members, from counts of cells in reach of it.
    reach = apart <= radius[:, None] + radius[None, :] + eps
    most = (reach & (radius >= 0)[None, :]) @ inner
    blocks = np.maximum(1, -(-inner // INNER_BLOCK))
    salts = np.maximum(1, -(-np.minimum(most, size) // OTHER_BLOCK))
    sent = spark.sparkContext.broadcast((pivots, radius, apart))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, apart = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                b = whole.slice(at, TILE)
                home = np.asarray(b.column(3))
                dots = unit(matrix(b.column(2))) @ pivots.T
                d = np.sqrt(np.maximum(0, 2 - 2 * dots))
                own = d[np.arange(len(d)), home][:, None]
                gap = apart[home]
                far = np.divide(d ** 2 - own ** 2, 2 * gap, out=np.zeros_like(d), where=gap > 0)
                near = (d <= own + 2 * eps) & (d <= radius + eps) & (far <= eps)
                near[np.arange(len(d)), home] = True
                r, c = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), *(b.column(i).take(pa.array(r)) for i in range(3))],
                                                 names=["cell", "id", "n", "v"])

    plan = spark.createDataFrame([(i, int(blocks[i]), int(salts[i])) for i in range(n_pivots)], "cell int, blocks int, salts int")
    deal = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = (homes.join(F.broadcast(plan), "cell").withColumn("block", deal("blocks")).withColumn("salt", every("salts"))
            .select("cell", "block", "salt", "id", "n", "v"))
    right = (homes.mapInArrow(members, "cell int, id long, n long, v array<double>")
             .join(F.broadcast(plan), "cell").withColumn("salt", deal("salts")).withColumn("block", every("blocks"))
             .select("cell", "block", "salt", "id", "n", "v"))

    def join(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "links": [], "least": []}).astype("int64")
        ids, links, least = link_block(a.id.to_numpy(np.int64), np.stack(a.v.to_numpy()), a.n.to_numpy(np.int64),
                                       b.id.to_numpy(np.int64), np.stack(b.v.to_numpy()), b.n.to_numpy(np.int64), cosine)
        return pd.DataFrame({"id": ids, "links": links, "least": least})

    key = ["cell", "block", "salt"]
    found = stage(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(join, "id long, links long, least long"), "range-links")
    group = components(found, "id", "least").withColumnRenamed("node", "id")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_class = classes.select("key", "id", "n").join(links, "id", "left").join(group, "id", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    component = F.coalesce("component", "id")
    return base.select("id", "key").join(by_class, "key", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op7_metric_range_join(spark, sf_dir: str) -> DataFrame:
    """Links of cosine >= 0.95 over all rows of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
