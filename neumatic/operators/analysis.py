"""Descriptive statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(rows: DataFrame, groups: list[str], label: str) -> DataFrame:
    """The most frequent label of each group, its share, count (n) and the group's (total); ties to the smallest label."""
    counts = rows.groupBy(*groups, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(*groups).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("label"))).alias("b"))
    return best.select(*groups, F.col("b.label").alias("majority"), (-F.col("b.n") / F.col("total")).alias("share"), (-F.col("b.n")).alias("n"), "total")


def statistics(rows: DataFrame, fine: list[str], coarse: list[str], value: str) -> DataFrame:
    """Count, sum and mean by ``fine`` and by ``coarse`` groups, in one pass."""
    sets = [fine, coarse]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in fine]).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def mean_and_deviation(rows: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """Percent mean and sample standard deviation over runs."""
    return rows.groupBy(*groups).agg(*(f for v in values for f in ((100 * F.avg(v)).alias(f"{v}_mean"), (100 * F.stddev_samp(v)).alias(f"{v}_std"))))


def pivot_mean(rows: DataFrame, index: str, column: str, names: list, value: str) -> DataFrame:
    return rows.groupBy(index).pivot(column, names).agg(F.avg(value))


def near_maximum(rows: DataFrame, groups: list[str], value: str, tolerance: float = 1.0) -> DataFrame:
    """``rows`` with is_top: within ``tolerance`` of the group's largest value."""
    largest = rows.groupBy(*groups).agg(F.max(value).alias("__max"))
    return rows.join(largest, groups).withColumn("is_top", F.col("__max") - F.col(value) < tolerance).drop("__max")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, groups: list[str] = []) -> DataFrame:  # noqa: B006
    bucket = F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return rows.groupBy(*groups, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def unpivot(rows: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return rows.unpivot(ids, values, name, value)


def duplication(rows: DataFrame, key: str, size: str) -> DataFrame:
    """One row: share of keys with several rows, and share of ``size`` that such keys hold."""
    by_key = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    many = F.col("n") > 1
    return by_key.agg(F.count("*").alias("keys"), F.count_if(many).alias("repeated"), (F.count_if(many) / F.count("*")).alias("share_of_keys"), (F.sum(F.when(many, F.col("size")).otherwise(0)) / F.sum("size")).alias("share_of_size"))


def most_frequent(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def note_name(pitch: Column) -> Column:
    from neumatic.functions.alphabet import NOTE_NAMES

    return F.get(F.array(*(F.lit(x) for x in NOTE_NAMES)), pitch % 12)


def tagged_union(runs: dict[str, DataFrame], name: str = "run") -> DataFrame:
    """All frames under each other, each row with its run."""
    frames = [df.withColumn(name, F.lit(run)) for run, df in runs.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def mean_ci(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Mean with a normal 95 % interval."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return rows.groupBy(*groups).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def rank_by(rows: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Smallest-rank order of a small table (one row a parameter set), best first."""
    return rows.withColumn(name, F.rank().over(Window.orderBy(F.desc(value))))


#: Pitch classes of the mode scales, both sevenths.
SCALE = (0, 2, 4, 5, 7, 9, 10, 11)


def scale_pitches(low: int, high: int) -> Column:
    """The pitches of the scale from ``low`` to ``high``, both included."""
    return F.filter(F.sequence(F.lit(low), F.lit(high)), lambda p: F.array_contains(F.array(*(F.lit(c) for c in SCALE)), p % 12))


def by_pitch(wide: DataFrame, ids: list[str], prefix: str) -> DataFrame:
    """(ids, pitch, value) of the columns ``prefix`` + number, the number cast."""
    long = wide.unpivot(ids, [c for c in wide.columns if c.startswith(prefix)], "feature", "value")
    return long.select(*ids, F.regexp_replace("feature", f"^{prefix}", "").cast("int").alias("pitch"), "value")


def row_mean(columns: list[str]) -> Column:
    """Mean across columns of a row; nulls do not count."""
    values = F.array_compact(F.array(*(F.col(c).cast("double") for c in columns)))
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def density(rows: DataFrame, value: str, points: list[float], bandwidth: float, groups: list[str] = []) -> DataFrame:  # noqa: B006
    """(groups, point, density): Gaussian kernel density at the points.

    Equal values are counted first, so what meets the points is a row a distinct value.
    """
    counts = rows.groupBy(*groups, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    spread = counts.select("*", F.explode(F.array(*(F.lit(float(p)) for p in points))).alias("point"))
    kernel = F.exp(-0.5 * F.pow((F.col("point") - F.col("__v")) / bandwidth, 2)) / (bandwidth * (2 * math.pi) ** 0.5)
    return spread.groupBy(*groups, "point").agg((F.sum(F.col("__n") * kernel) / F.sum("__n")).alias("density"))


def score_cell(mean: str, deviation: str) -> Column:
    """Mean and deviation as a table cell."""
    return F.format_string("$%.1f^{\\pm %.1f}$", F.col(mean), F.col(deviation))


def percent_cell(part: Column | str, whole: Column | str) -> Column:
    """``part`` of ``whole`` in percent with two decimals, rounded as C and Python print the double: exactly, ties to even.

    ``format_string`` rounds ties up, and what Java prints of the double instead of its value.
    """
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.concat(F.call_function("format_number", (100 * part / whole).cast("double"), F.lit("0.00")), F.lit("%"))


def param_string(params: Column) -> Column:
    """``k=v, ...`` of a map of strings."""
    return F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
