"""Classification scores from keyed predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    return pairs.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def accuracy(pairs: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    return pairs.agg(F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"))


def by_class(pairs: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """(label, precision, recall, f1, support); an undefined precision, recall or f1 is 0."""
    cells = confusion(pairs, truth, predicted)
    own = F.struct(F.col("y").alias("label"), F.lit("y").alias("side"), F.col("n").alias("support"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits"), F.lit(0).cast("long").alias("said"))
    other = F.struct(F.col("p").alias("label"), F.lit("p").alias("side"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("hits"), F.col("n").alias("said"))
    # from one row of cells, so that the predictions behind them are made once; a null is no label that both sides share
    both = cells.select(F.explode(F.array(own, other)).alias("c")).select("c.*").groupBy("label", F.when(F.col("label").isNull(), F.col("side")).alias("side"))
    both = both.agg(*(F.sum(c).alias(c) for c in ("support", "hits", "said")))
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("said")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    scored = both.select("label", precision.alias("precision"), recall.alias("recall"), "support")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return scored.select("label", "precision", "recall", f1.alias("f1"), "support")


def scores(pairs: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and f1."""
    classes = by_class(pairs, truth, predicted)
    total = F.sum("support")
    return classes.agg(*((F.sum(F.col(c) * F.col("support")) / total).alias(name) for c, name in (("recall", "accuracy"), ("precision", "weighted_precision"), ("recall", "weighted_recall"), ("f1", "weighted_f1"))))
