"""Text, ranking, vector and time columns on small fixtures."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from passages.functions import contents, ranking, status, text, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    "given, wanted",
    [("make a “Soak” roll…", 'make a "Soak" roll...'), ("ﬁre – ‘x’", "fire - 'x'"), ("", "")],
)
def test_punctuation(spark, given, wanted):
    assert one(spark, text.normalize_punctuation(F.col("t")), t=given) == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Roll D8 or 2D6-2, then 2d6-2 and 2D.", ["D8", "2D6-2", "2D"]),
        ("no dice here, id8x", []),
        ("2D6-2x", ["2D6"]),
    ],
)
def test_dice(spark, given, wanted):
    assert one(spark, text.dice_tokens(F.col("t")), t=given) == wanted


def test_dice_kept(spark):
    kept = text.keep_dice(F.col("a"), F.col("b"))
    assert one(spark, kept, a="what is 2D6 and d8", b="roll D8") == "roll D8 2D6"
    assert one(spark, kept, a="no dice", b=" as  given ") == " as  given "


def test_keywords(spark):
    assert one(spark, text.clean_keywords(F.col("t")), t=' "a, b,c"\nmore') == "a b c"
    merged = text.merge_words(F.col("a"), F.col("b"))
    assert one(spark, merged, a="wild attack", b="Wild Attack combat") == "wild attack combat"


def test_snippet(spark):
    body = "x " * 200 + "the wild attack hits " + "y " * 200
    cut = one(spark, text.snippet(F.col("t"), F.col("q")), t=body, q=" Wild Attack ")
    assert "wild attack" in cut and cut.endswith("…") and len(cut) <= 241
    assert one(spark, text.snippet(F.col("t"), F.col("q")), t=" short\n text ", q="q") == "short text"


def test_sharp_s_stays(spark):
    assert one(spark, text.count_words(F.col("t")), t="Straße a b2, é") == ["STRAßE", "B2", "É"]


def test_index_terms_like_sqlite(spark):
    sample = "Café Straße ÉTÉ naïve-ish 2D6-2 ø Ünïcode_x don't"
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(a)")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    con.execute("INSERT INTO f VALUES (?)", (sample,))
    wanted = [r[0] for r in con.execute("SELECT term FROM v ORDER BY offset")]
    assert one(spark, text.index_terms(F.col("t")), t=sample) == wanted


def fnv(word):
    h = 2166136261
    for byte in word.encode():
        h = ((h ^ byte) * 16777619) & 0xFFFFFFFF
    return h


@pytest.mark.parametrize("word", ["combat", "é", "straße", "漢字", "a😀b", ""])
def test_fnv(spark, word):
    assert one(spark, vectors.fnv1a(F.col("t")), t=word) == fnv(word)


def test_cosine(spark):
    c = vectors.cosine(F.col("a"), F.col("b"))
    assert one(spark, c, a=[1.0, 2.0], b=[2.0, 1.0]) == pytest.approx(0.8)
    assert one(spark, c, a=[1.0, 2.0], b=[1.0]) == 0.0
    assert one(spark, c, a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0


def test_title_boost(spark):
    boost = ranking.title_boost(F.col("t"), F.col("q"))
    assert one(spark, boost, t="Wild Attack", q="what does wild attack need?") == pytest.approx(0.12)
    assert one(spark, boost, t="abcdefgh", q="abc bcd cde def efg fgh") == pytest.approx(0.24)
    assert one(spark, boost, t="of to", q="of to") == 0.0


def test_table_penalty(spark):
    penalty = ranking.table_penalty(F.col("t"))
    table = "Weapon Damage Cost\n1 2 3 sword\n12 4 200\n7 8 9 axe"
    prose = "You may attack twice in round 2.\nEach attack takes a penalty."
    assert one(spark, penalty, t=table) == pytest.approx(0.18 * 3 / 4)
    assert one(spark, penalty, t=prose) == 0.0
    assert one(spark, penalty, t="") == 0.0


@pytest.mark.parametrize(
    "line, wanted",
    [
        ("Introduction ........ 5", ("Introduction", 5)),
        ("Character Creation … 12", ("Character Creation", 12)),
        ("Skills\t\t18", ("Skills", 18)),
        ("Edges and Hindrances  22", ("Edges and Hindrances", 22)),
        ("Characters\b9", ("Character", 9)),
        ("123", None),
        ("3 Goblins 45", ("Goblins 45", 3)),
        ("Section 12345", ("Section 1", 2345)),
        ("Player's Guide 7", ("Players Guide", 7)),
        ("Contents 1", None),
        ("", None),
    ],
)
def test_contents_line(spark, line, wanted):
    got = one(spark, contents.contents_entry(F.col("t")), t=line)
    assert (None if got is None else tuple(got)) == wanted


def test_times(spark):
    def parsed(t):
        return one(spark, status.format_time(status.parse_time(F.col("t"))), t=t)

    assert parsed("2026-08-27 18:31:20") == "2026-08-27T18:31:20Z"
    assert parsed("2026-08-27T18:31:20.123456789Z") == "2026-08-27T18:31:20.123456Z"
    assert parsed("2026-08-27T18:31:20+02:00") == "2026-08-27T16:31:20Z"
    assert parsed("  ") is None and parsed("soon") is None


def test_percent(spark):
    p = status.progress_percent(F.col("phase"), F.col("n"), F.col("of"))
    assert one(spark, p, phase="sections", n=1, of=2) == 34.0
    assert one(spark, p, phase="cheatsheet_llm", n=9, of=4) == 95.0
    assert one(spark, p, phase="error", n=1, of=1) == 0.0
    assert math.isclose(one(spark, p, phase="glossary_llm", n=1, of=0), 70.0)
