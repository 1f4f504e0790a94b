"""Exact vectors of the column functions."""

import pytest
from pyspark.sql import functions as F

from neumatic.functions import features, neume, represent, segment
from neumatic.functions.alphabet import characters

MELODY = "1---fg---h--ij-h-3-f-4"
CASES = [
    (neume.expand_accidentals, "ijjj", {}, "ijijij"),
    (neume.expand_accidentals, "ijjj", {"omit_notes": True}, "iii"),
    (neume.expand_accidentals, "ij3j", {"omit_notes": True}, "i3j"),
    (neume.expand_accidentals, "ijjIjj", {"omit_notes": True}, "iijj"),
    (neume.expand_accidentals, "ijjIjj", {}, "ijijjj"),
    (neume.clean, MELODY, {}, "fghijhf"),
    (neume.clean, MELODY, {"keep_boundaries": True}, ""),
    (neume.clean, MELODY, {"keep_bars": True}, "fghijh|f|"),
    (neume.clean, MELODY, {"keep_boundaries": True, "neume": ".", "syllable": "-", "word": "$"}, "$fg$h-ij.h-f."),
    (neume.clean, MELODY, {"keep_boundaries": True, "neume": ".", "syllable": "-", "word": "$", "keep_bars": True}, "$fg$h-ij.h|-f|."),
    (neume.process, "h-3-f", {}, "h--f"),
    (neume.contains_notes, "1---6", {}, False),
    (neume.contains_notes, "FG", {}, True),
    (neume.contains_notes, "i", {"accidentals_are_notes": False}, False),
    (neume.split_string, "this-is-a-test", {"sep": "-"}, ["this-", "is-", "a-", "test"]),
    (neume.split_string, "this-is-a-test", {"sep": "-", "keep_sep": False}, ["this", "is", "a", "test"]),
    (neume.split_melody, "f-g-h--", {"sep": "-"}, ["f-", "g-", "h--"]),
    (neume.split_melody, "f-g-h--", {"sep": "-", "keep_sep": False}, ["f", "g", "h--"]),
    (segment.kmers, "abcdefghijklmno", {"k": 4}, ["abcd", "efgh", "ijkl", "mno"]),
    (segment.kmers, "", {"k": 4}, []),
    (segment.natural, "f--g---h-g", {"kind": "words"}, ["fg", "hg"]),
    (segment.natural, "f-g--hg---f------", {"kind": "syllables"}, ["fg", "hg", "f"]),
    (segment.natural, "fg-h-f---g--", {"kind": "neumes"}, ["fg", "h", "f", "g"]),
    (represent.pitches, "cdefghjk", {}, [60, 62, 64, 65, 67, 69, 71, 72]),
    (represent.pitches, "c3d", {}, [60, 62]),
    (represent.pitches, "c3d", {"fill_na": True}, [60, None, 62]),
    (represent.pitches, "ij", {"skip_accidentals": True}, [71]),
    (represent.represent, "ab caa b", {"kind": "interval"}, ".² ¹₃- ²"),
    (represent.represent, "ab|caa|b", {"kind": "interval", "sep": "|"}, ".²|¹₃-|²"),
    (represent.represent, "ab caa b", {"kind": "interval", "segment": False}, ".²¹₃-²"),
    (represent.represent, "ab caa b", {"kind": "interval", "segment": False, "first_interval_empty": False}, "²¹₃-²"),
    (represent.represent, "ab caa b", {"kind": "interval", "repeat_first_note": True}, "-² ¹₃- ²"),
    (represent.represent, "ab caa b", {"kind": "contour"}, ".⌃ ⌃⌄- ⌃"),
    (represent.represent, "ab caa b", {"kind": "contour", "repeat_first_note": True}, "-⌃ ⌃⌄- ⌃"),
    (represent.represent, "ab caa b", {"kind": "contour", "dependent": False}, ".⌃ .⌄- ."),
]


@pytest.mark.parametrize("function,value,options,expected", CASES)
def test_vectors(spark, function, value, options, expected):
    if options == {"keep_boundaries": True}:
        options, expected = options | {"neume": " ", "syllable": " "}, " fg h ij h f "
    row = spark.createDataFrame([(value,)], "v string").select(function(F.col("v"), **options)).first()
    assert row[0] == expected


def test_nulls_stay_null(spark):
    row = spark.createDataFrame([(None,)], "v string").select(neume.process(F.col("v")), segment.natural(F.col("v"), "words"), represent.pitches(F.col("v"))).first()
    assert tuple(row) == (None, None, None)


def test_arrays(spark):
    df = spark.createDataFrame([([60, 62, 64, 60],), ([],), ([60],)], "p array<int>")
    assert [r[0] for r in df.select(represent.intervals(F.col("p"))).collect()] == [[2, 2, -4], [], []]
    codes = spark.createDataFrame([([1, 2, 3, 4, 0, -4, -3, -2, -1],)], "p array<int>").select(represent.encode_intervals(F.col("p"))).first()[0]
    assert codes == "¹²³⁴-₄₃₂₁"
    assert spark.createDataFrame([([None, 2, 0, -2],)], "p array<int>").select(represent.encode_contour(F.col("p"))).first()[0] == ".⌃-⌄"


def test_copy_segmentation(spark):
    df = spark.createDataFrame([("ab cde", "12345")], "s string, t string")
    assert df.select(represent.copy_segmentation(F.col("s"), F.col("t"))).first()[0] == "12 345"
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([("ab cd", "123456")], "s string, t string").select(represent.copy_segmentation(F.col("s"), F.col("t"))).collect()


def test_features(spark):
    df = spark.createDataFrame([([60, 62, 64, 65, 64],), ([],)], "p array<int>")
    rows = df.select(*(c.alias(n) for n, c in (features.classical(F.col("p")) | features.gesture(F.col("p"))).items())).collect()
    assert tuple(rows[0]) == (60, 64, 60, 65, 5, 60, 62, 64)
    assert set(rows[1]) == {None}


def profile(spark, function, pitches):
    coded = "".join(map(chr, pitches))
    return spark.createDataFrame([(coded,)], "c string").select(*(c.alias(n) for n, c in function(F.col("c")).items())).first().asDict()


def test_profiles(spark):
    found = profile(spark, features.pitch_profile, [60, 60, 62, 64, 62])
    assert len(found) == 34 and found["freq_MIDI_60"] == 0.4 and found["freq_MIDI_64"] == 0.2
    assert list(profile(spark, features.pitch_class_profile, [60, 60, 62, 64, 62]).values()) == [0.4, 0, 0.4, 0, 0.2, 0, 0, 0, 0, 0, 0, 0]
    found = profile(spark, features.repetition_profile, [60, 60, 60, 61, 61, 62, 60, 60, 60])
    assert [found[f"repetition_score_MIDI_{p}"] for p in (60, 61, 62, 63)] == [0.5, 0.125, 0, 0]
    assert set(profile(spark, features.repetition_profile, [60]).values()) == {None}


def test_poisson(spark):
    df = spark.createDataFrame([(i, "abcdefghj" * 200) for i in range(5)] + [(9, "")], "id long, notes string")
    for mean in (1, 5):
        rows = segment.poisson(df, mean).orderBy("id", "unit_no").collect()
        for i in range(5):
            units = [r.unit for r in rows if r.id == i]
            assert "".join(units) == "abcdefghj" * 200
            assert abs(1800 / len(units) - mean) < 0.6
    assert not [r for r in rows if r.id == 9]


def test_poisson_is_cut_inside_the_row(spark):
    text = "".join(chr(97 + i % 20) for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, "a"), (3, ""), (4, None), (5, "ab")], "id long, notes string")
    for mean in (1, 3, 7):
        found = segment.poisson(df, mean, seed=2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan  # a row a note that holds the melody fills the disk
        sizes = {(r.id, r.no): r.size for r in spark.range(1, 6).selectExpr("id", "explode(sequence(0, 2999)) no").select("id", "no", segment.poisson_size(F.col("id"), F.col("no"), mean, 2).alias("size")).collect()}
        cdf = segment.poisson_cdf(mean - 1)
        u = spark.range(1, 6).selectExpr("id", "explode(sequence(0, 2999)) no").select("id", "no", segment.uniform("id", "no", seed=2).alias("u"))
        assert mean == 1 or all(sizes[r.id, r.no] == 1 + sum(x <= r.u for x in cdf) for r in u.collect())
        expected = []
        for i, notes in ((1, text), (2, "a"), (5, "ab")):
            at = no = 0
            while at < len(notes):
                expected.append((i, no, notes[at : at + sizes[i, no]]))
                at, no = at + sizes[i, no], no + 1
        assert sorted(map(tuple, found.collect())) == expected


def test_copy_segmentation_of_long_texts(spark):
    words = ["abcdefghij"[: 1 + i % 10] for i in range(400)] + ["x" * 700, "é" * 3]
    rows = spark.createDataFrame([(" ".join(words), "".join(words).upper())], "s string, t string")
    cut = rows.select(represent.copy_segmentation(F.col("s"), F.col("t")).alias("c"))
    assert cut.first()[0] == " ".join(words).upper()
    both = rows.select(represent.cutting(F.col("t"), lambda part: part(F.lit(250), F.lit(20))).alias("c"), F.substring("t", 251, 20).alias("d")).first()
    assert both.c == both.d


def test_alphabet():
    assert characters() == "3456712()ABCDEFGHJKLMNOPQRSIWXYZ89abcdefghjklmnopqrsiwxyz.,-[]{¶"
    assert characters("naturals", "flats") == "IWXYZiwxyz"


def test_accidentals_on_random_strings(spark):
    import random

    from neumatic.functions.alphabet import FLAT_OF_NOTE

    def by_hand(text, omit):
        on, out = set(), ""
        for c in text:
            if c in FLAT_OF_NOTE.values():
                on.add(c)
            elif c in "IYZWX":
                on.discard(c.lower())
            elif c in "3456":
                on.clear()
                out += c
            elif FLAT_OF_NOTE.get(c) in on:
                out += FLAT_OF_NOTE[c] + ("" if omit else c)
            else:
                out += c
        return out

    rng = random.Random(4)
    texts = ["".join(rng.choices("ijbyqzewmxIYZWXJB3456-ac\n", k=rng.randint(0, 60))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for omit in (True, False):
        got = [r[0] for r in rows.select(neume.expand_accidentals(F.col("t"), omit)).collect()]
        assert got == [by_hand(t, omit) for t in texts]
