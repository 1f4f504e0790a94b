"""Classifiers, randomized search and keyed predictions."""

from __future__ import annotations

import json
import math
import random
import time

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, OneVsRest, OneVsRestModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neumatic.operators import metrics
from neumatic.operators.knn import neighbours, vote

RF_SPACE = {
    "criterion": ["gini", "entropy"],
    "n_estimators": range(100, 1000),
    "max_depth": range(1, 1000),
    "max_features": [i / 99 for i in range(100)],
    "bootstrap": [True, False],
    "max_samples": [0.5 + i / 198 for i in range(100)],
}
KNN_SPACE = {"n_neighbors": range(1, 50), "weights": ["uniform", "distance"]}
SVC_SPACE = {"C": ("loguniform", 1e-3, 1e4)}


def sample_params(space: dict, n: int, seed: int = 0) -> list[dict]:
    """``n`` random settings of a space of lists, ranges and log-uniform intervals."""
    rng = random.Random(seed)

    def one(values):
        if isinstance(values, tuple) and values[0] == "loguniform":
            return math.exp(rng.uniform(math.log(values[1]), math.log(values[2])))
        return rng.choice(values)

    return [{k: one(v) for k, v in space.items()} for _ in range(n)]


class Forest:
    """Random forest; depth is held to 30, which Spark allows, and shares of 0 to the smallest."""

    def __init__(self, criterion="gini", n_estimators=100, max_depth=30, max_features=1.0, bootstrap=True, max_samples=1.0, seed=0, **_):
        strategy = str(min(1.0, max(float(max_features), 0.01)))
        self.inner = RandomForestClassifier(featuresCol="features", labelCol="label", impurity=criterion, numTrees=int(n_estimators), maxDepth=min(int(max_depth), 30), featureSubsetStrategy="all" if strategy == "1.0" else strategy, bootstrap=bootstrap, subsamplingRate=float(max_samples), seed=seed, maxBins=64)

    def fit(self, train: DataFrame):
        self.model = self.inner.fit(train)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).select("id", F.col("label").alias("y"), F.col("prediction").alias("p"))


class LinearMargin:
    """One linear support vector machine a class (hinge loss)."""

    def __init__(self, C=1.0, iterations=50, **_):
        self.c, self.iterations = C, iterations

    def fit(self, train: DataFrame):
        svc = LinearSVC(maxIter=self.iterations, regParam=min(10.0, 1.0 / (self.c * max(train.count(), 1))))
        self.model = OneVsRest(classifier=svc, featuresCol="features", labelCol="label").fit(train)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).select("id", F.col("label").alias("y"), F.col("prediction").alias("p"))


class SquaredMargin:
    """Linear support vector machines with squared hinge loss, by distributed gradient sums.

    Each step sends the weights out and sums the gradients of all classes in
    one pass, so no task or driver holds the rows.
    """

    def __init__(self, C=1.0, steps=30, **_):
        self.c, self.steps = C, steps

    def fit(self, train: DataFrame):
        rows = train.select(F.col("label").cast("int").alias("label"), vector_to_array("features").alias("x")).cache()
        size, last = rows.agg(F.max(F.size("x")), F.max("label")).first()
        width, classes = (size or 0) + 1, (last or 0) + 1
        w, speed, step = np.zeros((classes, width)), np.zeros((classes, width)), None
        for k in range(self.steps):
            ahead = w + 0.9 * speed
            shared = rows.sparkSession.sparkContext.broadcast(ahead)  # one weight a class and feature

            def slopes(frames, shared=shared):
                total, norm = np.zeros_like(shared.value), 0.0
                for frame in frames:
                    x = np.column_stack([np.array(frame["x"].tolist(), float), np.ones(len(frame))])
                    y = np.where(np.arange(len(total))[None] == frame["label"].to_numpy()[:, None], 1.0, -1.0)
                    short = np.maximum(0, 1 - y * (x @ shared.value.T))
                    total -= 2 * (y * short).T @ x
                    norm += float((x * x).sum())
                yield pd.DataFrame({"g": [total.ravel().tolist()], "norm": [norm]})

            parts = rows.mapInPandas(slopes, "g array<double>, norm double")
            # a row a weight, summed before the shuffle; the square norm stands behind the weights
            sums = parts.select(F.posexplode(F.concat("g", F.array("norm"))).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toPandas()
            total = np.zeros(w.size + 1)
            total[sums["i"].to_numpy(int)] = sums["v"].to_numpy(float)
            gradient = ahead + self.c * total[:-1].reshape(w.shape)
            step = step or 1.0 / (1.0 + 2 * self.c * max(total[-1], 1e-9) / 4)
            new = ahead - step * gradient
            speed, w = new - w, new
        rows.unpersist()
        self.w = w
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(self.w)

        def say(frames):
            for frame in frames:
                x = np.column_stack([np.array(frame["x"].tolist(), float), np.ones(len(frame))])
                yield pd.DataFrame({"id": frame["id"], "y": frame["y"], "p": (x @ shared.value.T).argmax(1).astype(float)})

        kind = rows.schema["id"].dataType.simpleString()
        return rows.select("id", F.col("label").cast("double").alias("y"), vector_to_array("features").alias("x")).mapInPandas(say, f"id {kind}, y double, p double")


class Nearest:
    """k nearest neighbours."""

    def __init__(self, n_neighbors=5, weights="uniform", **_):
        self.k, self.weights = n_neighbors, weights

    def fit(self, train: DataFrame):
        self.train = self._rows(train)
        return self

    @staticmethod
    def _rows(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), vector_to_array("features").alias("embedding"))

    def predict(self, rows: DataFrame) -> DataFrame:
        said = vote(neighbours(self.train, self._rows(rows), self.k), self.weights)
        return rows.select("id", F.col("label").alias("y")).join(said, F.col("id") == F.col("query")).select("id", "y", F.col("prediction").cast("double").alias("p"))


CLASSIFIERS = {"random_forest": (Forest, RF_SPACE), "linear_svc": (SquaredMargin, SVC_SPACE), "hinge_svc": (LinearMargin, SVC_SPACE), "knn": (Nearest, KNN_SPACE)}


def tune(rows: DataFrame, classifier: str, n_iter: int, seed: int = 0, fold: str = "fold", space: dict | None = None, prepare=None) -> list[dict]:
    """A row per sampled setting: mean, deviation and rank of four scores over the folds, test and train.

    ``prepare(train) -> function`` fits features inside each fold (a vectorizer, say).
    """
    make, default = CLASSIFIERS[classifier]
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())  # one row a fold
    out = []
    for params in sample_params(space or default, n_iter, seed):
        found: dict[str, list[float]] = {}
        for k in folds:
            train, test = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
            change = prepare(train) if prepare else (lambda x: x)
            began = time.time()
            model = make(**params).fit(change(train))
            found.setdefault("fit_time", []).append(time.time() - began)
            for name, part in (("test", test), ("train", train)):
                row = metrics.scores(model.predict(change(part))).first()
                for score, value in row.asDict().items():
                    found.setdefault(f"{name}_{score}", []).append(value)
        out.append({"params": params} | {f"mean_{k}": float(np.mean(v)) for k, v in found.items()} | {f"std_{k}": float(np.std(v)) for k, v in found.items()})
    for name in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1"):
        values = [row[f"mean_test_{name}"] for row in out]
        for row in out:
            row[f"rank_test_{name}"] = 1 + sum(v > row[f"mean_test_{name}"] for v in values)
    return sorted(out, key=lambda row: row["rank_test_accuracy"])


def train_best(train: DataFrame, classifier: str, tuned: list[dict]):
    """The classifier with the settings of rank 1, fitted on all rows."""
    return CLASSIFIERS[classifier][0](**tuned[0]["params"]).fit(train)


def save(model, path: str, spark: SparkSession) -> None:
    """Write a fitted classifier: what kind it is, its settings, and what it learned."""
    kind = next(name for name, (make, _) in CLASSIFIERS.items() if type(model) is make)
    settings = {"k": model.k, "weights": model.weights} if kind == "knn" else {}
    spark.createDataFrame([(kind, json.dumps(settings))], "kind string, settings string").write.mode("overwrite").parquet(f"{path}/about")
    if kind == "knn":
        model.train.write.mode("overwrite").parquet(f"{path}/learned")
    elif kind == "linear_svc":
        rows = [(i, [float(x) for x in w]) for i, w in enumerate(model.w)]
        spark.createDataFrame(rows, "label int, w array<double>").write.mode("overwrite").parquet(f"{path}/learned")
    else:
        model.model.write().overwrite().save(f"{path}/learned")


def load(path: str, spark: SparkSession):
    """The classifier that ``save`` wrote; it predicts as before."""
    kind, settings = spark.read.parquet(f"{path}/about").first()
    settings = json.loads(settings)
    model = CLASSIFIERS[kind][0]()
    if kind == "knn":
        model.k, model.weights, model.train = settings["k"], settings["weights"], spark.read.parquet(f"{path}/learned")
    elif kind == "linear_svc":
        model.w = np.array([r.w for r in spark.read.parquet(f"{path}/learned").orderBy("label").collect()])  # a row a class
    else:
        model.model = (RandomForestClassificationModel if kind == "random_forest" else OneVsRestModel).load(f"{path}/learned")
    return model
