"""Operator 8: exact top-k search by inner product as a Voronoi kNN join.

1. Pivots, a bounded sample of the data, cut the space into cells; every vector
   goes to the cell of its nearest pivot.
2. A summary holds for each cell how many vectors lie within which distance of
   its pivot.  Queries are grouped by their own cell, in blocks of bounded size.
3. For a query group with pivot p and radius r and a vector x at distance e
   from pivot s, |q.x - p.s| is at most |p|e + r|s| + re.  The summaries so
   give each group a score that its k-th best is sure to reach.
4. A vector travels to a group only if q.x <= p.x + r|x| can reach that score;
   cells out of reach are skipped as a whole.
5. Groups are solved in blocks with numpy, and the blocks' top k merged.

Vectors are integers, and scores exact.  Cases: null vectors, null or
non-finite components and null ids take no part; repeated equal rows count
once; a candidate with the query's id is the query's own row; shorter vectors
count as ending in zeros; ties go to the smaller id; an empty table gives an
empty result; fewer candidates than k give them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, stage, table
from .vectors import finite, matrix, padded

ROWS_PER_PIVOT = 4000
MOST_PIVOTS = 1024
QUERIES_PER_BLOCK = 1000
DATA_PER_BLOCK = 50_000
DISTANCE_BINS = 256
CHUNK = 4096


def _assign(pivots: np.ndarray, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots ** 2).sum(axis=1) / 2
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                cell = np.argmin(half - x @ pivots.T, axis=1)
                dist = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                bins = np.minimum(dist / width, DISTANCE_BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(bins)],
                                                 names=["vec_id", "v", "cell", "dist", "bin"])
    return run


def assured(pivots: np.ndarray, summary: tuple[np.ndarray, np.ndarray, np.ndarray], centre: np.ndarray, radius: float, k: int, own: int = 1) -> float:
    """A score that k candidates of every query within ``radius`` of ``centre`` reach.

    ``summary`` holds cell, edge and number of rows of each ring; at most ``own``
    rows have a query's id and are none of its candidates."""
    cell, edge, count = summary
    p = pivots[cell]
    low = p @ centre - np.linalg.norm(centre) * edge - radius * (np.linalg.norm(p, axis=1) + edge)
    order = np.argsort(-low)
    reach = np.cumsum(count[order])
    at = int(np.searchsorted(reach, k + own))
    return float(low[order][at]) if at < len(order) else -np.inf


def top_pairs(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the query, id, score) of each query's k best, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    big = float(np.abs(q).sum(axis=1).max(initial=0)) * float(np.abs(x).max(initial=0))
    if big < 2 ** 52:
        q, x = q.astype(np.float64), x.astype(np.float64)
    row, got, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor = np.full(len(q), -np.inf)
    for at in range(0, len(ids), CHUNK):
        part = ids[at:at + CHUNK]
        s = q @ x[at:at + CHUNK].T
        own = q_ids[:, None] == part[None, :]
        level = np.where(own, -np.inf, s)
        if len(part) > k:
            cut = np.maximum(floor, np.partition(level, len(part) - k, axis=1)[:, len(part) - k])
        else:
            cut = floor
        r, c = np.nonzero((level >= cut[:, None]) & ~own)
        row, got = np.concatenate([row, r]), np.concatenate([got, part[c]])
        score = np.concatenate([score, s[r, c].astype(np.int64)])
        order = np.lexsort((got, -score, row))
        row, got, score = row[order], got[order], score[order]
        first = np.searchsorted(row, np.arange(len(q)))
        rank = np.arange(len(row)) - first[row]
        keep = rank < k
        floor[row[rank == k - 1]] = score[rank == k - 1]
        row, got, score = row[keep], got[keep], score[keep]
    return row, got, score


def knn_join(data: DataFrame, is_query, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``data`` (vec_id long, v array of long); ``is_query`` picks the queries."""
    spark = data.sparkSession
    arrow_batches(spark)
    base = stage(padded(data, "v", F.lit(0).cast("long")).distinct(), "knn-rows")
    n = base.count()
    out = "query_id long, vec_id long, score long"
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    final = lambda df: df.select("query_id", F.row_number().over(ranked).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    if not n:
        return final(spark.createDataFrame([], out))
    n_pivots = max(1, min(MOST_PIVOTS, n // ROWS_PER_PIVOT))
    pivots = np.array([r.v for r in base.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(n_pivots).select("v").collect()], np.float64).reshape(n_pivots, -1)
    width = max(1e-9, 2 * float(np.sqrt((pivots ** 2).sum(axis=1).max(initial=0))) / DISTANCE_BINS)
    cells = stage(base.select("vec_id", "v").mapInArrow(_assign(pivots, width), "vec_id long, v array<long>, cell int, dist double, bin int"), "knn-cells")
    summary = cells.groupBy("cell", "bin").agg(F.count("*").alias("n"), F.max("dist").alias("edge")).collect()
    queries = cells.where(is_query)
    asked = queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()
    if not asked:
        return final(spark.createDataFrame([], out))
    own_rows = queries.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    rings = np.array([s.cell for s in summary]), np.array([s.edge for s in summary]), np.array([s.n for s in summary])
    # Per query group, bounded by the pivots: the score assured, and how many rows its cells in reach hold.
    held: dict[int, list[float]] = {}
    for s in summary:
        c = held.setdefault(s.cell, [0, 0.0])
        c[0], c[1] = c[0] + s.n, max(c[1], s.edge)
    own = np.array(sorted(held))
    rows, reach = np.array([held[c][0] for c in own]), np.array([held[c][1] for c in own])
    norms = np.linalg.norm(pivots, axis=1)
    groups = []
    for a in asked:
        p = pivots[a.cell]
        sure = assured(pivots, rings, p, a.radius, k, own_rows)
        most = pivots[own] @ p + norms[a.cell] * reach + a.radius * (norms[own] + reach)
        slack = 1e-9 * (1 + abs(sure)) if np.isfinite(sure) else 0.0
        near = most >= sure - slack
        blocks = -(-a.n // QUERIES_PER_BLOCK)
        salts = max(1, -(-int(rows[near].sum()) // DATA_PER_BLOCK))
        groups.append((a.cell, a.radius, sure - slack, blocks, salts, set(own[near].tolist())))
    sent = spark.sparkContext.broadcast((pivots[[g[0] for g in groups]], np.array([g[1] for g in groups]), np.array([g[2] for g in groups]),
                                         np.array([g[4] for g in groups]),
                                         np.array([[c in g[5] for c in range(n_pivots)] for g in groups])))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, radius, sure, salts, near = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                x, ids = matrix(b.column(1)), np.asarray(b.column(0))
                best = x @ centre.T + np.linalg.norm(x, axis=1)[:, None] * radius
                slack = 1e-9 * (1 + np.abs(best))
                r, g = np.nonzero((best + slack >= sure) & near[:, np.asarray(b.column(2))].T)
                # A multiplicative hash deals a cell's rows over the salts evenly.
                salt = ((ids[r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % salts[g].astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(ids[r]),
                     b.column(1).take(pa.array(r))], names=["g", "salt", "vec_id", "v"])

    plan = spark.createDataFrame([(g[0], i, g[3], g[4]) for i, g in enumerate(groups)], "cell int, g int, blocks int, salts int")
    replicas = cells.select("vec_id", "v", "cell").mapInArrow(replicate, "g int, salt int, vec_id long, v array<long>")
    # A block of queries meets every salt of its group; each salted row meets every block of its group.
    left = (queries.join(F.broadcast(plan), "cell")
            .withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            .select("g", "block", "salt", "vec_id", "v"))
    right = (replicas.join(F.broadcast(plan.select("g", "blocks")), "g")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("g", "block", "salt", "vec_id", "v"))

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = q.vec_id.to_numpy(np.int64)
        row, got, score = top_pairs(ids, np.stack(q.v.to_numpy()), x.vec_id.to_numpy(np.int64), np.stack(x.v.to_numpy()), k)
        return pd.DataFrame({"query_id": ids[row], "vec_id": got, "score": score})

    key = ["g", "block", "salt"]
    return final(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(solve, out))


def quantised(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the rows that take part."""
    return rows.where(F.col(id_col).isNotNull() & finite(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def op8_voronoi_knn(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all other rows for each row of ``embeddings`` whose id is divisible by 50."""
    return knn_join(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)
