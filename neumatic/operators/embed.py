"""Two-dimensional embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows at most that t-SNE is fitted on; it is quadratic in them.
TSNE_ROWS = 5000
#: Matrices of so many columns at most are decomposed by the products of their columns.
GRAM_WIDTH = 256
#: Fitted rows that place each other row.
NEIGHBOURS = 3


def pca(rows: DataFrame, k: int = 2) -> DataFrame:
    """(id, x, y): projections of the centred features; the sign of an axis is arbitrary."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="__c").fit(rows).transform(rows)
    out = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred).transform(centred)
    p = vector_to_array("__p")
    return out.select("id", F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))


def right_vectors(rows: DataFrame, k: int) -> np.ndarray:
    """The first k right singular vectors, fewer of a matrix of lower rank."""
    first = rows.select(F.size(vector_to_array("features"))).first()
    if first is None or first[0] > GRAM_WIDTH:
        return RowMatrix(rows.select("features").rdd.map(lambda r: OldVectors.dense(r[0].toArray()))).computeSVD(k).V.toArray()
    width = first[0]

    def products(frames):
        total = np.zeros((width, width))
        for frame in frames:
            x = np.array(frame["x"].tolist(), float).reshape(-1, width)
            total += x.T @ x
        yield pd.DataFrame({"g": [total.ravel().tolist()]})

    parts = rows.select(vector_to_array("features").alias("x")).mapInPandas(products, "g array<double>")
    # a row a cell, summed before the shuffle: the driver gets one matrix
    sums = parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    gram = np.zeros(width * width)
    gram[sums["i"].to_numpy(int)] = sums["v"].to_numpy(float)
    values, vectors = np.linalg.eigh(gram.reshape(width, width))
    sigma = np.sqrt(np.maximum(values[::-1][:k], 0))
    return vectors[:, ::-1][:, :k][:, sigma >= 1e-9 * sigma[0]]


def svd(rows: DataFrame, k: int = 2) -> DataFrame:
    """(id, v): projections on the first k right singular vectors, without centring."""
    basis = right_vectors(rows, k)  # features x k
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def project(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "v": (np.array(frame["x"].tolist(), float) @ shared.value).tolist()})

    return rows.select("id", vector_to_array("features").alias("x")).mapInPandas(project, f"id {kind_of(rows)}, v array<double>")


def kind_of(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def tsne_array(x: np.ndarray, perplexity: float = 30.0, steps: int = 300, rate: float = 200.0, seed: int = 0) -> np.ndarray:
    """Exact t-SNE of a small array."""
    n = len(x)
    if n < 3:
        return np.zeros((n, 2))
    sq = (x * x).sum(1)
    d = np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0)
    goal = np.log(min(perplexity, (n - 1) / 3))
    p = np.zeros((n, n))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        own = np.delete(d[i], i)
        for _ in range(50):
            e = np.exp(-(own - own.min()) * beta)
            total = e.sum()
            entropy = np.log(total) + beta * ((own - own.min()) * e).sum() / total
            if abs(entropy - goal) < 1e-5:
                break
            if entropy > goal:
                low, beta = beta, beta * 2 if high == np.inf else (beta + high) / 2
            else:
                high, beta = beta, (beta + low) / 2
        p[i, np.arange(n) != i] = e / total
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    speed, gains = np.zeros_like(y), np.ones_like(y)
    for t in range(steps):
        sq = (y * y).sum(1)
        q = 1 / (1 + np.maximum(sq[:, None] + sq[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        g = ((12.0 if t < 100 else 1.0) * p - q / q.sum()) * q
        slope = 4 * (g.sum(1)[:, None] * y - g @ y)
        gains = np.maximum(np.where(np.sign(slope) != np.sign(speed), gains + 0.2, gains * 0.8), 0.01)
        speed = (0.5 if t < 100 else 0.8) * speed - rate * gains * slope
        y = y + speed
        y -= y.mean(0)
    return y


def tsne(rows: DataFrame, perplexity: float = 30.0, steps: int = 300, seed: int = 0, most_rows: int = TSNE_ROWS) -> DataFrame:
    """(id, x, y) of every row; wide features go through SVD first.

    t-SNE is fitted on the ``most_rows`` rows of the smallest hashes of id, or
    on all rows if there are no more.  Every other row stands at the mean of its
    nearest fitted rows, weighted by inverse distance.
    """
    kind, width = kind_of(rows), rows.select(F.size(vector_to_array("features"))).first()
    if width is not None and width[0] > 50:
        rows = svd(rows, 50)
    else:
        rows = rows.select("id", vector_to_array("features").alias("v"))
    h = F.xxhash64("id")
    bound = rows.select(h.alias("h")).orderBy("h").limit(most_rows).agg(F.max("h")).first()[0]
    fitted = F.coalesce(h <= F.lit(bound), F.lit(True))

    def embed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        y = tsne_array(np.array(frame["v"].tolist(), float), perplexity, steps, seed=seed)
        return pd.DataFrame({"id": frame["id"].to_numpy(), "v": frame["v"].tolist(), "x": y[:, 0], "y": y[:, 1]})

    fit = rows.where(fitted).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(embed, f"id {kind}, v array<double>, x double, y double").toPandas()
    spark = rows.sparkSession
    own = spark.createDataFrame(fit[["id", "x", "y"]], f"id {kind}, x double, y double")
    shared = spark.sparkContext.broadcast((np.array(fit["v"].tolist(), float), fit[["x", "y"]].to_numpy()))  # at most most_rows

    def place(frames):
        known, at = shared.value
        k = min(NEIGHBOURS, len(known))
        for frame in frames:
            for i in range(0, len(frame), 1000):
                part = frame.iloc[i : i + 1000]
                v = np.array(part["v"].tolist(), float)
                d = np.maximum((v * v).sum(1)[:, None] + (known * known).sum(1)[None] - 2 * v @ known.T, 0)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                weight = 1 / (np.sqrt(np.take_along_axis(d, near, 1)) + 1e-9)
                xy = (at[near] * weight[:, :, None]).sum(1) / weight.sum(1)[:, None]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "x": xy[:, 0], "y": xy[:, 1]})

    return own.unionByName(rows.where(~fitted).mapInPandas(place, f"id {kind}, x double, y double"))
