"""tf-idf over melodic units, as relations and as an ml pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_FEATURES = 5000


def term_counts(units: DataFrame, key: str = "id") -> DataFrame:
    """(key, term, tf) from (key, units array)."""
    return units.select(key, F.explode("units").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, size: int = MAX_FEATURES) -> DataFrame:
    """(term, ctf, df): the most frequent terms of the corpus, ties by term."""
    return counts.groupBy("term").agg(F.sum("tf").alias("ctf"), F.count("*").alias("df")).orderBy(F.desc("ctf"), "term").limit(size)


def weights(counts: DataFrame, vocab: DataFrame, documents: int, key: str = "id") -> DataFrame:
    """(key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), each document of unit length."""
    x = F.col("tf") * (F.log(F.lit(1.0 + documents) / (1.0 + F.col("df"))) + 1)
    joined = counts.join(F.broadcast(vocab.select("term", "df")), "term").withColumn("x", x)  # at most MAX_FEATURES terms
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return joined.select(key, "term", (F.col("x") / norm).alias("weight"))


def tfidf(units: DataFrame, key: str = "id", size: int = MAX_FEATURES, documents: int | None = None) -> DataFrame:
    """Weights of every document's terms; ``documents`` is their number, where the caller can count them more cheaply."""
    counts = term_counts(units, key)
    return weights(counts, vocabulary(counts, size), units.count() if documents is None else documents, key)


class VectorizerModel:
    """Fitted stages: counts, idf with one added, unit length."""

    def __init__(self, stages: list):
        self.stages = stages

    def transform(self, df: DataFrame) -> DataFrame:
        return PipelineModel(self.stages).transform(df).drop("__tf", "__x")

    def save(self, path: str) -> None:
        PipelineModel(self.stages).write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> VectorizerModel:
        return cls(PipelineModel.load(path).stages)


def fit_vectorizer(df: DataFrame, units: str = "units", output: str = "features", size: int = MAX_FEATURES) -> VectorizerModel:
    counts = CountVectorizer(inputCol=units, outputCol="__tf", vocabSize=size, minDF=1.0).fit(df)
    idf = IDF(inputCol="__tf", outputCol="__i").fit(counts.transform(df)).idf.toArray() + 1.0
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__x")
    return VectorizerModel([counts, scale, Normalizer(p=2.0, inputCol="__x", outputCol=output)])
