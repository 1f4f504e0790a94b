"""k nearest neighbours, exact, in blocks of training rows and of queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of either side in one block.
BLOCK_ROWS = 50_000
#: Distances held at once by a task.
CELLS = 4_000_000
#: Candidates of a query beyond which its distances are all computed at once.
CANDIDATES = 4_000
#: Partitions for each pair of blocks.
SPREAD = 4
FOUND = "query long, train long, label int, distance double"


def nearest(vectors: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of vectors, distance) of the k nearest of each row of q, in order; ties to the smaller row.

    Matrix products bound the squared distances to within rounding; those that
    may be among the k are computed from the differences.
    """
    k = min(k, len(vectors))
    norms = (vectors * vectors).sum(1)
    step, out = max(1, CELLS // len(vectors)), []
    for at in range(0, len(q), step):
        part = q[at : at + step]
        own = (part * part).sum(1)
        near = part @ (-2 * vectors.T)
        near += norms
        near += own[:, None]
        bound = np.partition(near, k - 1, axis=1)[:, k - 1] + 1e-10 * (own + norms.max())
        near = near <= bound[:, None]
        many = ~np.isfinite(bound) | (near.sum(1) > CANDIDATES)
        near[many] = False
        row, col = np.nonzero(near)
        d = np.sqrt(((part[row] - vectors[col]) ** 2).sum(1))
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        out.append((at + row[keep], col[keep], d[keep]))
        for i in np.nonzero(many)[0]:
            all_ = np.sqrt(((part[i] - vectors) ** 2).sum(1))
            best = np.argsort(all_, kind="stable")[:k]
            out.append((np.full(k, at + i), best, all_[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def neighbours(train: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", label: str = "label", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, train, label, distance): the k nearest training rows of each query, ties by training key.

    Both sides are dealt into blocks by hash, and every block of training rows
    meets every block of queries in a task of its own, which keeps the k best;
    a last step merges them.  Neither side passes the driver.
    """
    spark = queries.sparkSession
    blocks = max(1, math.ceil(train.count() / block_rows))
    sides = max(1, math.ceil(queries.count() / block_rows), math.ceil(spark.sparkContext.defaultParallelism / blocks))

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int, *columns: str) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own)
        return rows.select(*columns, block, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def search(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if known.empty or asked.empty:
            return pd.DataFrame({"query": [], "train": [], "label": [], "distance": []})
        known = known.sort_values(key, kind="stable")
        ids, labels, vectors = known[key].to_numpy(np.int64), known[label].to_numpy(np.int32), np.array(known[vector].tolist(), float)
        own, q = asked[key].to_numpy(np.int64), np.array(asked[vector].tolist(), float)
        row, best, d = nearest(vectors, q, k)
        return pd.DataFrame({"query": own[row], "train": ids[best], "label": labels[best], "distance": d})

    # a number of partitions given is kept, so that few pairs of blocks share a task
    left = dealt(train, "t", blocks, "q", sides, key, label, vector).repartition(SPREAD * blocks * sides, "t", "q").groupBy("t", "q")
    right = dealt(queries, "q", sides, "t", blocks, key, vector).repartition(SPREAD * blocks * sides, "t", "q").groupBy("t", "q")
    found = left.cogroup(right).applyInPandas(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "train"))
    return found.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")


def vote(near: DataFrame, weighting: str = "uniform") -> DataFrame:
    """(query, prediction): by count, or by inverse distance; at distance 0 only those rows vote; ties to the smallest label."""
    if weighting == "uniform":
        weight = F.lit(1.0)
    else:
        zero = F.max(F.when(F.col("distance") == 0, 1).otherwise(0)).over(Window.partitionBy("query")) == 1
        weight = F.when(zero, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    sums = near.withColumn("w", weight).groupBy("query", "label").agg(F.round(F.sum("w"), 6).alias("w"))
    best = sums.groupBy("query").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("m"))
    return best.select("query", (-F.col("m.l")).alias("prediction"))
