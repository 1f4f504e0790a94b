"""Pitches, intervals and contours of melodies.

Units are written as one string with a separator, so a representation is one
pass over characters: the note before a note is the character before it, or the
one before that where a separator stands between.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from neumatic.functions.alphabet import DOWN, INTERVAL_CODES, LARGEST_INTERVAL, NO_INTERVAL, PITCHES, SAME, UP, char_class, characters

_CHARS = "".join(PITCHES)
_CODES = "".join(chr(p) for p in PITCHES.values())


def let(value: Column, function) -> Column:
    """``function(value)`` with ``value`` computed once; inside another lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), lambda v: function(v)), F.lit(0))


#: Characters of the pieces that long texts are cut from.
PIECE = 256


def cutting(text: Column, function) -> Column:
    """``function(cut)``, where ``cut(begin, size)`` is the part of the text from ``begin`` (from 0).

    ``substring`` counts characters from the beginning of its text; parts are
    cut from pieces, so that all of them are linear in the text.
    """
    def bound(whole: Column) -> Column:
        def cut(pieces: Column):
            def part(begin: Column, size: Column) -> Column:
                no, rest = F.floor(begin / PIECE).cast("int"), begin % PIECE
                two = F.concat(F.coalesce(F.get(pieces, no), F.lit("")), F.coalesce(F.get(pieces, no + 1), F.lit("")))
                return F.when(rest + size <= 2 * PIECE, F.substring(two, rest + 1, size)).otherwise(F.substring(whole, begin + 1, size))

            return function(part)

        return let(F.regexp_extract_all(whole, F.lit(f"((?s).{{1,{PIECE}}})"), F.lit(1)), cut)

    return let(text, bound)


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def pitches(melody: Column, fill_na: bool = False, skip_accidentals: bool = False) -> Column:
    """MIDI pitches; characters that are no note are left out, or null."""
    if skip_accidentals:
        melody = F.regexp_replace(melody, char_class(characters("flats", "naturals")), "")
    if not fill_na:
        return F.transform(_letters(pitch_string(melody)), lambda c: F.ascii(c))
    coded = F.translate(F.regexp_replace(melody, char_class(_CHARS, negate=True), "\x01"), _CHARS, _CODES)
    return F.transform(_letters(coded), lambda c: F.when(c != "\x01", F.ascii(c)))


def pitch_string(melody: Column) -> Column:
    """One character a note, whose code is the MIDI pitch."""
    return F.translate(F.regexp_replace(melody, char_class(_CHARS, negate=True), ""), _CHARS, _CODES)


def intervals(notes: Column) -> Column:
    """Differences of neighbours."""
    return let(notes, lambda a: F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: x - F.get(a, i)))


def interval_code(interval: Column, strict: bool = True) -> Column:
    """One character for an interval of up to 23 semitones; larger ones are an error, or ``?``."""
    code = F.get(F.array(*(F.lit(c) for c in INTERVAL_CODES)), interval + LARGEST_INTERVAL)
    other = F.lit("?") if not strict else None
    return F.when(interval.isNull(), F.lit(NO_INTERVAL)).otherwise(F.coalesce(code, other if other is not None else F.raise_error(F.concat(F.lit("no code for interval "), interval.cast("string"))).cast("string")))


def contour_code(interval: Column) -> Column:
    return F.when(interval.isNull(), F.lit(NO_INTERVAL)).when(interval == 0, F.lit(SAME)).when(interval > 0, F.lit(UP)).otherwise(F.lit(DOWN))


def encode_intervals(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: interval_code(x)), "")


def encode_contour(values: Column) -> Column:
    return F.array_join(F.transform(values, contour_code), "")


def represent(units: Column, kind: str, dependent: bool = True, segment: bool = True, first_interval_empty: bool = True, repeat_first_note: bool = False, sep: str = " ", strict: bool = True) -> Column:
    """Interval or contour representation of notes in units, a string with separators.

    Dependent units go on from the note before; independent ones start afresh,
    with the empty code first.  The first note of all has the empty code, or the
    code of a repetition, or none.
    """
    code = {"interval": lambda x: interval_code(x, strict), "contour": contour_code}[kind]
    letters = _letters(units if segment else F.replace(units, F.lit(sep), F.lit("")))
    numbers = F.transform(letters, lambda c: F.when(c == sep, F.lit(None)).otherwise(F.ascii(F.translate(c, _CHARS, _CODES))))

    def at(coded: Column, here: Column, i: Column) -> Column:
        one, two = F.get(coded, i - 1), F.get(coded, i - 2)
        before = F.coalesce(one, two) if dependent else one
        if repeat_first_note and dependent:
            before = F.when(i == 0, here).otherwise(before)
        value = code(here - before)
        if dependent and not first_interval_empty and not repeat_first_note:
            value = F.when(i == 0, F.lit("")).otherwise(value)
        return F.when(here.isNull(), F.lit(sep)).otherwise(value)

    return let(numbers, lambda coded: F.array_join(F.transform(coded, lambda here, i: at(coded, here, i)), ""))


def representation(units: Column, kind: str, dependent: bool, strict: bool = True) -> Column:
    """The representation of an array of units, as an array of units."""
    joined = F.array_join(units, " ")
    out = represent(joined, kind, dependent=dependent, repeat_first_note=dependent, strict=strict)
    return F.filter(F.split(out, " "), lambda u: u != "")


def copy_segmentation(source: Column, target: Column, sep: str = " ", validate: bool = True) -> Column:
    """``target`` cut like ``source``, whose units ``sep`` separates."""
    letters = _letters(source)
    marks = F.filter(F.transform(letters, lambda c, i: F.when(c == sep, i)), lambda i: i.isNotNull())
    ends = F.concat(F.transform(marks, lambda i, k: i - k), F.array(F.length(target)))

    def parts_of(cut) -> Column:
        def part(bounds: Column, end: Column, k: Column) -> Column:
            begin = F.coalesce(F.get(bounds, k - 1), F.lit(0))
            return cut(begin, end - begin)

        return let(ends, lambda bounds: F.transform(bounds, lambda end, k: part(bounds, end, k)))

    parts = cutting(target, parts_of)
    out = F.array_join(parts, sep)
    if not validate:
        return out
    same = F.length(F.replace(source, F.lit(sep), F.lit(""))) == F.length(target)
    return F.when(same, out).otherwise(F.raise_error(F.lit("source and target differ in length")).cast("string"))


def char_table(text: Column, size: int = 100) -> Column:
    """Codes of the first ``size`` characters; null beyond the end."""
    return let(_letters(text), lambda a: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.ascii(F.get(a, i))))
