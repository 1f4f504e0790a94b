"""Melody strings: accidentals, cleaning, splitting.  All take and return columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from neumatic.functions.alphabet import FLAT_OF_NOTE, char_class, characters

MARK = "\x01"
KEPT = characters("notes", "liquescents", "flats", "naturals")


#: What stands for a sounding flat until the signs are gone.
SOUNDING = dict(zip(FLAT_OF_NOTE.values(), "\x10\x11\x12\x13\x14"))


def _sounded(melody: Column, omit_notes: bool, barlines: str) -> Column:
    """Each note where its flat sounds as a character of SOUNDING; the signs are still there.

    A sounding note follows its sign, or the sounding note before it, with no
    sign or barline between: the match goes on where the last one ended.
    """
    for note, flat in FLAT_OF_NOTE.items():
        between = f"[^{flat}{flat.upper()}{note}{barlines}]*+"
        melody = F.regexp_replace(melody, f"({flat}|(?!^)\\G)({between}){note}", "$1$2" + SOUNDING[flat] + ("" if omit_notes else note))
    return melody


def _written(sounded: Column) -> Column:
    return F.translate(sounded, "".join(SOUNDING.values()), "".join(SOUNDING))


def expand_accidentals(melody: Column, omit_notes: bool = False, barlines: str = "3456") -> Column:
    """Write each flat where it sounds: in place of its note, or before it.

    A flat sign holds for its note until the natural or a barline; signs
    themselves are left out.  One pass for each of the five flats.
    """
    signs = char_class(characters("flats", "naturals"))
    return _written(F.regexp_replace(_sounded(melody, omit_notes, barlines), signs, ""))


def clean(melody: Column, allowed: str | None = None, keep_boundaries: bool = False, neume: str = "", syllable: str = "", word: str = " ", keep_bars: bool = False, bars: str = "345", bar: str = "|") -> Column:
    """Keep notes only, or notes and boundary marks.

    Dashes count up between notes: each third one writes ``word``, and what is
    left before the next note or the end writes ``neume`` or ``syllable``.
    Bars are written where they stand and do not interrupt the count.
    """
    allowed = characters("notes", "liquescents", "flats", "naturals") if allowed is None else allowed
    bars = bars if keep_bars else ""
    kept = F.regexp_replace(melody, char_class(allowed + bars + ("-" if keep_boundaries else ""), negate=True), "")
    if keep_bars:
        kept = F.translate(kept, bars, "\x04" * len(bars))
    if keep_boundaries:
        kept = F.regexp_replace(kept, "-(\x04*)-(\x04*)-", "$1$2\x03")
        kept = F.regexp_replace(kept, "-(\x04*)-(\x04*)", "$1$2\x02")
        kept = F.regexp_replace(kept, "-(\x04*)", "$1\x01")
        for mark, text in (("\x01", neume), ("\x02", syllable), ("\x03", word)):
            kept = F.replace(kept, F.lit(mark), F.lit(text))
    return F.replace(kept, F.lit("\x04"), F.lit(bar)) if keep_bars else kept


def contains_notes(melody: Column, accidentals_are_notes: bool = True) -> Column:
    groups = ["notes", "liquescents"] + ["flats", "naturals"] * accidentals_are_notes
    return melody.rlike(char_class(characters(*groups)))


def has_no_notes(melody: Column) -> Column:
    return ~contains_notes(melody)


def split_string(text: Column, sep: str, keep_sep: bool = True) -> Column:
    """Parts between separators; all but the last keep theirs if asked."""
    if not keep_sep:
        return F.split(text, "\\Q" + sep + "\\E")
    return F.split(F.replace(text, F.lit(sep), F.lit(sep + MARK)), MARK)


def split_melody(melody: Column, sep: str, keep_sep: bool = True) -> Column:
    """Like ``split_string``, but the dashes at the end stay with the last part."""
    body, tail = F.regexp_replace(melody, "-*$", ""), F.regexp_extract(melody, "(-*)$", 1)
    # the tail goes behind the last part, where no separator is looked for: its dashes are other characters until then
    marked = F.concat(body, F.translate(tail, "-", "\x05"))
    return F.transform(split_string(marked, sep, keep_sep), lambda part: F.translate(part, "\x05", "-"))


def process(melody: Column) -> Column:
    """Flats written out, then only notes, liquescents, accidentals and dashes."""
    kept = characters("notes", "liquescents") + "".join(SOUNDING.values()) + "-"
    return _written(F.regexp_replace(_sounded(melody, True, "3456"), char_class(kept, negate=True), ""))


def notes_only(processed: Column) -> Column:
    return F.replace(processed, F.lit("-"), F.lit(""))
