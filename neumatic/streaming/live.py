"""Streaming versions: additions, not part of the batch study.

Row filters and column functions need no change on a stream; these are the
stateful steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neumatic.functions.neume import clean


def unique_notes(chants: DataFrame, time: str, delay: str) -> DataFrame:
    """The first chant of each melody within the watermark."""
    keyed = chants.withWatermark(time, delay).withColumn("__notes", F.xxhash64(clean(F.col("volpiano"))))
    return keyed.dropDuplicatesWithinWatermark(["__notes"]).drop("__notes")


def windowed_counts(events: DataFrame, time: str, delay: str, window: str, groups: list[str]) -> DataFrame:
    """Events of each window and group; later ones than the watermark are dropped."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), *groups).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *groups, "n")
