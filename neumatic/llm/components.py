"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neumatic.llm.common import discard, release, written


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``edges`` (u, v).

    Alternating large-star and small-star rounds; each is a pre-aggregated
    minimum and a join back, so a node with very many neighbours is split like
    any skewed join.  Every round is written to the shared folder.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    stamp = _stamp(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
        release(edges.sparkSession)
        before, stamp = stamp, _stamp(edges)
        if before == stamp:
            break
    else:
        raise RuntimeError("components did not settle")
    least = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return least.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
