"""Exact samples and folds by hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neumatic.operators.filters import draw


def exact_sample(rows: DataFrame, fraction: float, seed: int = 0, key: str = "id") -> DataFrame:
    """``rows`` with is_train: true for exactly the rounded share, in hash order.

    The cut is the hash of the last row taken, which a bounded search finds from
    counts by hash prefix; no global sort or single-partition window is made.
    """
    hashed = rows.withColumn("__h", draw(key, seed=seed))
    total = rows.count()
    wanted = int(rows.sparkSession.range(1).select(F.bround(F.lit(fraction * total))).first()[0])
    prefix, left = "", wanted
    while True:
        width = len(prefix) + 3
        counts = sorted((r[0], r[1]) for r in hashed.where(F.col("__h").startswith(prefix)).groupBy(F.substring("__h", 1, width)).count().collect())
        for value, n in counts:  # at most 4096
            if left < n:
                break
            left -= n
        else:
            cut = "g"
            break
        if left == 0:
            cut = value
            break
        if n <= 1000 or width >= 30:
            inside = sorted(r[0] for r in hashed.where(F.col("__h").startswith(value)).select("__h").collect())  # at most 1000
            cut = inside[left]
            break
        prefix = value
    return hashed.withColumn("is_train", F.col("__h") < cut).drop("__h")


def stratified_folds(rows: DataFrame, label: str, k: int, seed: int = 0, key: str = "id") -> DataFrame:
    """``rows`` with fold 0..k-1: each label's rows in hash order, dealt out in turn.

    Ranks come from salted groups and a table of group sizes, so one label may hold any share.
    """
    salts = 256
    hashed = rows.withColumn("__h", draw(key, seed=seed)).withColumn("__s", F.substring("__h", 1, 2))
    sizes = hashed.groupBy(label, "__s").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(label).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(label).alias("__l"), F.col("__s").alias("__t"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    assert salts == 16**2
    at = F.row_number().over(Window.partitionBy(label, "__s").orderBy("__h", key)) - 1
    joined = hashed.withColumn("__at", at).join(starts, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__s") == F.col("__t")))
    return joined.withColumn("fold", ((F.col("__begin") + F.col("__at")) % k).cast("int")).drop("__h", "__s", "__l", "__t", "__begin", "__at")


def random_rows(rows: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """``n`` rows drawn by hash order."""
    return rows.orderBy(draw(key, seed=seed), key).limit(n)


def head(rows: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The first ``n`` rows by key."""
    return rows.orderBy(key).limit(n)
