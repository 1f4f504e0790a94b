"""Filters over chant tables, with a funnel report in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neumatic.functions.alphabet import char_class, characters
from neumatic.functions.neume import clean


def has_melody() -> Column:
    return F.col("volpiano").isNotNull()


def has_notes() -> Column:
    return F.coalesce(F.col("volpiano").rlike(char_class(characters("notes", "liquescents"))), F.lit(False))


def only_alphabet() -> Column:
    return F.coalesce(F.col("volpiano").rlike("^" + char_class(characters()) + "*$"), F.lit(False))


def no_f_clef() -> Column:
    return ~F.coalesce(F.col("volpiano").contains("2"), F.lit(False))


def starts_with_g_clef() -> Column:
    return F.coalesce(F.col("volpiano").startswith("1"), F.lit(False))


def no_missing_pitches() -> Column:
    return F.coalesce(~F.col("volpiano").contains("6------6"), F.lit(False))


def of_genre(include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """``include`` decides alone where it is given; a null genre passes only an exclusion."""
    if include:
        return F.coalesce(F.col("genre_id").isin(include), F.lit(False))
    return ~F.coalesce(F.col("genre_id").isin(exclude or [""]), F.lit(False))


def simple_mode(include_transposed: bool = True) -> Column:
    return F.coalesce(F.col("mode").rlike("^[1-8]T?$" if include_transposed else "^[1-8]$"), F.lit(False))


def has_full_text() -> Column:
    return F.col("full_text").isNotNull()


def incipit_is_not_all() -> Column:
    return F.col("full_text").isNull() | F.col("incipit").isNull() | (F.col("full_text") != F.col("incipit"))


def has_word_boundary() -> Column:
    return F.coalesce(F.col("volpiano").contains("---"), F.lit(False))


def pipeline(genre: str) -> list[tuple[str, Column]]:
    """The row filters in their order."""
    return [
        ("has melody", has_melody()),
        ("has notes", has_notes()),
        ("simple mode", simple_mode(False)),
        ("has full text", has_full_text()),
        ("incipit is not all", incipit_is_not_all()),
        ("genre", of_genre([genre])),
        ("starts with G clef", starts_with_g_clef()),
        ("no F clef", no_f_clef()),
        ("no missing pitches", no_missing_pitches()),
        ("only alphabet", only_alphabet()),
        ("has word boundary", has_word_boundary()),
    ]


def unique_notes(chants: DataFrame, order: str = "id") -> DataFrame:
    """The first row, by ``order``, of each melody's bare notes.

    A pre-aggregated minimum and a semi join: no task gathers the copies of one melody.
    """
    keyed = chants.withColumn("__notes", F.xxhash64(clean(F.col("volpiano"))))
    first = keyed.groupBy("__notes").agg(F.min(order).alias(order))
    return keyed.join(first, ["__notes", order], "left_semi").drop("__notes").select(*chants.columns)


def draw(*columns: str, seed: int = 0) -> Column:
    """A fixed random order: a hash of the columns and the seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def one_per_mode_and_family(chants: DataFrame, seed: int = 0) -> DataFrame:
    """One random row of each (cantus_id, mode); rows without a cantus_id go."""
    keyed = chants.where("cantus_id is not null").withColumn("__draw", F.struct(draw("id", seed=seed).alias("d"), F.col("id")))
    first = keyed.groupBy("cantus_id", "mode").agg(F.min("__draw").alias("__first"))
    first = first.select(F.col("cantus_id").alias("__c"), F.col("mode").alias("__m"), "__first")
    match = (F.col("cantus_id") == F.col("__c")) & F.col("mode").eqNullSafe(F.col("__m")) & (F.col("__draw") == F.col("__first"))
    return keyed.join(first, match, "left_semi").drop("__draw")


def funnel(chants: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step_no, step, before, after, removed): all the cumulative counts in one aggregation."""
    passed, counts = F.lit(True), [F.count("*").alias("c0")]
    for i, (_, keep) in enumerate(steps, 1):
        passed = passed & keep
        counts.append(F.count_if(passed).alias(f"c{i}"))
    one = chants.agg(*counts)
    rows = F.array(*(F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"c{i - 1}").alias("before"), F.col(f"c{i}").alias("after")) for i, (name, _) in enumerate(steps, 1)))
    return one.select(F.inline(rows)).withColumn("removed", F.col("before") - F.col("after"))


def filter_chants(chants: DataFrame, genre: str, one_per_family: bool = False, seed: int = 0) -> DataFrame:
    """The whole filter: rows, then copies, then optionally one row of each family and mode."""
    for _, keep in pipeline(genre):
        chants = chants.where(keep)
    chants = unique_notes(chants)
    return one_per_mode_and_family(chants, seed) if one_per_family else chants
