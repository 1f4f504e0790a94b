"""Segmentations: arrays of units, each a string of notes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neumatic.functions.represent import cutting, let

NATURAL = {"words": "-{3,}", "syllables": "-{2,}", "neumes": "-+"}
KMERS = range(1, 17)
POISSON_MEANS = (3, 5, 7)


def natural(processed: Column, kind: str) -> Column:
    """Words, syllables or neumes: what stands between runs of at least three, two or one dashes."""
    parts = F.transform(F.split(processed, NATURAL[kind]), lambda part: F.replace(part, F.lit("-"), F.lit("")))
    return F.filter(parts, lambda part: part != "")


def kmers(notes: Column, k: int) -> Column:
    """Units of k notes one after the other; the last may be shorter."""
    return F.regexp_extract_all(notes, F.lit(f"((?s).{{1,{k}}})"), 1)


def segmentations(processed: Column, k_min: int = 1, k_max: int = 16) -> dict[str, Column]:
    """Every natural and fixed-length segmentation by name."""
    notes = F.replace(processed, F.lit("-"), F.lit(""))
    return {kind: natural(processed, kind) for kind in NATURAL} | {f"{k}-mer": kmers(notes, k) for k in range(k_min, k_max + 1)}


def poisson_cdf(mean: float) -> list[float]:
    """P(draw <= x) for a Poisson draw, up to where it is 1 in double precision."""
    total, term, out = 0.0, math.exp(-mean), []
    for x in range(1000):
        total += term
        out.append(round(total, 12))
        term *= mean / (x + 1)
        if total > 1 - 1e-12:
            break
    return out


def uniform(*parts: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the parts and the seed only."""
    text = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


#: Sizes of one block of a running sum.
BLOCK = 16


def starts_of(sizes: Column) -> Column:
    """Sums of the sizes before each, in blocks, so that no fold copies a long array."""
    def running(values: Column, value) -> Column:
        """One more entry than ``values``: 0 and the sums up to each."""
        return F.aggregate(values, F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + value(x))))

    def joined(blocks: Column) -> Column:
        before = running(blocks, lambda sums: F.element_at(sums, -1))
        return let(before, lambda begin: F.flatten(F.transform(blocks, lambda sums, b: F.transform(F.slice(sums, 1, F.size(sums) - 1), lambda x: x + F.get(begin, b)))))

    def blocks(all_: Column) -> Column:
        count = F.floor((F.size(all_) + BLOCK - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda b: running(F.slice(all_, b * BLOCK + 1, BLOCK), lambda x: x))

    return let(sizes, lambda all_: let(blocks(all_), joined))


def poisson_size(key: Column, no: Column, mean: int, seed: int = 0) -> Column:
    """1 + Poisson(mean - 1), drawn from the key, the unit's number and the seed."""
    cdf = poisson_cdf(mean - 1)

    def steps(u: Column, low: int, high: int) -> Column:
        """How many of cdf[low:high] are at most u, and ``low`` more, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(u < cdf[middle], steps(u, low, middle)).otherwise(steps(u, middle + 1, high))

    return F.lit(1) if mean == 1 else 1 + let(uniform(key, no, seed=seed), lambda u: steps(u, 0, len(cdf)))


def poisson_places(key: Column, length: Column, mean: int, seed: int = 0) -> Column:
    """The units of a melody of so many notes as an array of (unit_no, start, size).

    Sizes are drawn for some more units than the mean needs, and for one a note
    only where those run out before the notes do.
    """
    def drawn(count: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), count - 1), lambda no: poisson_size(key, no, mean, seed))

    def places(notes: Column) -> Column:
        likely = F.least(notes, F.floor(notes * 1.2 / mean).cast("int") + 16)
        enough = let(drawn(likely), lambda sizes: F.when(F.aggregate(sizes, F.lit(0), lambda a, x: a + x) >= notes, sizes).otherwise(drawn(notes)))
        placed = let(enough, lambda sizes: F.transform(starts_of(sizes), lambda start, no: F.struct(no.alias("unit_no"), start.alias("start"), F.get(sizes, no).alias("size"))))
        return F.filter(placed, lambda x: x["start"] < notes)

    if mean < 1:
        raise ValueError("mean must be at least 1")
    return let(length, places)


def poisson_units(key: Column, notes: Column, mean: int, seed: int = 0) -> Column:
    """The units of one melody as an array of (unit_no, unit); null without notes."""
    def units(text: Column) -> Column:
        places = poisson_places(key, F.length(text), mean, seed)
        cut_up = cutting(text, lambda cut: F.transform(places, lambda x: F.struct(x["unit_no"].alias("unit_no"), cut(x["start"], x["size"]).alias("unit"))))
        return F.when(F.length(text) > 0, cut_up)

    return let(notes, units)


def unit_counts(key: Column, processed: Column, seed: int = 0) -> dict[str, Column]:
    """The number of units of every segmentation by name, as of ``experiment.units_table``; units that numbers give are not made."""
    length = F.length(F.replace(processed, F.lit("-"), F.lit("")))
    counts = {kind: F.size(natural(processed, kind)) for kind in NATURAL} | {f"{k}-mer": F.ceil(length / k) for k in KMERS}
    return counts | {f"poisson-{m}": F.when(length > 0, F.size(poisson_places(key, length, m, seed + m))).otherwise(0) for m in POISSON_MEANS}


def poisson(melodies: DataFrame, mean: int, seed: int = 0, key: str = "id", notes: str = "notes") -> DataFrame:
    """(key, unit_no, unit): units whose lengths are 1 + Poisson(mean - 1), until the notes run out.

    Lengths are drawn from the key, the unit's number and the seed, and a running
    sum gives where each starts, all inside the melody's row: the work is linear
    in the notes, needs no Python, and nothing is shuffled.
    """
    return melodies.select(key, F.explode(poisson_units(F.col(key), F.col(notes), mean, seed)).alias("u")).select(key, "u.unit_no", "u.unit")
