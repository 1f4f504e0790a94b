"""Features of pitch sequences.

Profiles count characters of the pitch string by how much shorter it gets
without them, which stays inside generated code and is linear in the notes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from neumatic.functions.alphabet import HIGHEST, LOWEST

PITCH_RANGE = range(LOWEST, HIGHEST + 1)
FEATURE_SETS = {
    "final": ["final"],
    "ambitus": ["lowest", "highest"],
    "initial": ["initial"],
    "final-ambitus": ["final", "lowest", "highest"],
    "final-initial": ["final", "initial"],
    "final-ambitus-initial": ["final", "lowest", "highest", "initial"],
    "ambitus-initial": ["lowest", "highest", "initial"],
}
PROFILES = {
    "pitch": [f"freq_MIDI_{p}" for p in PITCH_RANGE],
    "pitch_class": [f"freq_pitch_class_{c}" for c in range(12)],
    "repetition": [f"repetition_score_MIDI_{p}" for p in PITCH_RANGE],
}


def classical(notes: Column) -> dict[str, Column]:
    """First, last, lowest and highest pitch and their range; null for an empty melody."""
    return {
        "initial": F.get(notes, F.lit(0)),
        "final": F.try_element_at(notes, F.lit(-1)),
        "lowest": F.array_min(notes),
        "highest": F.array_max(notes),
        "ambitus": F.array_max(notes) - F.array_min(notes),
    }


def gesture(notes: Column, size: int = 3) -> dict[str, Column]:
    """The first pitches; null where the melody is shorter."""
    return {f"initial_gesture_{i + 1}": F.get(notes, F.lit(i)) for i in range(size)}


def _count(coded: Column, pitch: int) -> Column:
    return (F.length(coded) - F.length(F.replace(coded, F.lit(chr(pitch)), F.lit("")))).cast("double")


def pitch_profile(coded: Column) -> dict[str, Column]:
    """Share of each pitch among the notes."""
    return {f"freq_MIDI_{p}": F.try_divide(_count(coded, p), F.length(coded)) for p in PITCH_RANGE}


def pitch_class_profile(coded: Column) -> dict[str, Column]:
    counts = {c: sum((_count(coded, p) for p in PITCH_RANGE if p % 12 == c), F.lit(0.0)) for c in range(12)}
    return {f"freq_pitch_class_{c}": F.try_divide(counts[c], F.length(coded)) for c in range(12)}


def repeated(coded: Column) -> Column:
    """The notes that the same one follows."""
    return F.regexp_replace(coded, r"(.)(?!\1)", "")


def repetition_profile(coded: Column, again: Column | None = None) -> dict[str, Column]:
    """Share of neighbouring notes that repeat each pitch; null for one note or none.

    ``again`` is ``repeated(coded)`` where the caller has it in a column of its own.
    """
    again = repeated(coded) if again is None else again
    return {f"repetition_score_MIDI_{p}": F.try_divide(_count(again, p), F.length(coded) - 1) for p in PITCH_RANGE}


def all_features(notes: Column, coded: Column, again: Column | None = None) -> dict[str, Column]:
    """All 88 columns."""
    return classical(notes) | gesture(notes) | pitch_profile(coded) | pitch_class_profile(coded) | repetition_profile(coded, again)
