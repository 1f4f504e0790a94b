"""Note alphabet, pitches and codes."""

from __future__ import annotations

# Character groups of the notation, MIDI pitches, interval and contour codes.
GROUPS = {
    "bars": "34567",
    "clefs": "12",
    "liquescents": "()ABCDEFGHJKLMNOPQRS",
    "naturals": "IWXYZ",
    "notes": "89abcdefghjklmnopqrs",
    "flats": "iwxyz",
    "spaces": ".,-",
    "others": "[]{¶",
}
NOTE_PITCHES = (53, 55, 57, 59, 60, 62, 64, 65, 67, 69, 71, 72, 74, 76, 77, 79, 81, 83, 84, 86)
FLAT_PITCHES = {"i": 70, "w": 63, "x": 75, "y": 58, "z": 82}
NATURAL_PITCHES = {"I": 71, "W": 64, "X": 76, "Y": 59, "Z": 83}
FLAT_OF_NOTE = {"j": "i", "b": "y", "q": "z", "e": "w", "m": "x"}
INTERVAL_CODES = "nmlkjihgfedcba₉₈₇₆₅₄₃₂₁-¹²³⁴⁵⁶⁷⁸⁹ABCDEFGHIJKLMN"
NO_INTERVAL, SAME, UP, DOWN = ".", "-", "⌃", "⌄"
LOWEST, HIGHEST = 53, 86
NOTE_NAMES = ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")

PITCHES = dict(zip(GROUPS["notes"], NOTE_PITCHES)) | dict(zip(GROUPS["liquescents"], NOTE_PITCHES)) | FLAT_PITCHES | NATURAL_PITCHES
LARGEST_INTERVAL = len(INTERVAL_CODES) // 2


def characters(*groups: str) -> str:
    """The characters of the groups named, or of all."""
    return "".join(GROUPS[g] for g in groups or GROUPS)


def char_class(chars: str, negate: bool = False) -> str:
    """A regular-expression class that Java and RE2 read alike."""
    return "[" + "^" * negate + "".join("\\" + c if c in "\\]^-[" else c for c in chars) + "]"
