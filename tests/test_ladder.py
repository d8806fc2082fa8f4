"""Rungs of the verdict ladder, ties, the second pass and elimination, case by case."""

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import search as S
from lodeframe.operators import verdicts as V

AGREES = {"truncated": False, "border": "black", "kb": "black", "frame": "modern", "kf": "2015", "year": 2016, "released": 2016, "line": "Ann Lee", "artist": "Ann Lee", "ka": "Ann Lee"}
CASES = [
    ({}, ("", 0.85)),
    ({"truncated": True, "frame": "old"}, ("truncated-image", None)),
    ({"truncated": None}, ("", 0.85)),
    ({"frame": "old", "year": 1990}, ("frame-mismatch", None)),
    ({"frame": "old", "kf": "1997"}, ("", 0.85)),
    ({"frame": "old", "kf": "future"}, ("", 0.85)),
    ({"frame": "old", "kf": None}, ("", 0.85)),
    ({"frame": "", "kf": "1993"}, ("", 0.85)),
    ({"year": 2013}, ("copyright-year-mismatch", None)),
    ({"year": 2014}, ("", 0.85)),
    ({"year": None}, ("", 0.85)),
    ({"line": "Bo Ray"}, ("artist-mismatch", None)),
    ({"line": "ANN LEE"}, ("", 0.85)),
    ({"line": ""}, ("", 0.85)),
    ({"artist": "Bo Ray"}, ("", 0.65)),
    ({"border": "white"}, ("", 0.65)),
    ({"border": "white", "artist": "Bo Ray"}, ("", 0.65)),
    ({"border": "", "artist": None}, ("", 0.85)),
    ({"ka": None}, ("", 0.85)),
    ({"border": "white", "frame": "old"}, ("frame-mismatch", None)),
]


def test_rungs(spark):
    schema = "k int, truncated boolean, border string, kb string, frame string, kf string, year int, released int, line string, artist string, ka string"
    rows = spark.createDataFrame([(k, *{**AGREES, **changed}.values()) for k, (changed, _) in enumerate(CASES)], schema)
    c = F.col
    rung = V.ladder(F.lit(0.85), truncated=c("truncated"), border=c("border"), known_border=c("kb"), frame=c("frame"), known_frame=c("kf"), year=c("year"), released=c("released"), line_artist=c("line"), artist=c("artist"), known_artist=c("ka"))
    assert {r.k: (r.skip_reason, r.confidence) for r in rows.select("k", rung.alias("r")).select("k", "r.*").collect()} == {k: want for k, (_, want) in enumerate(CASES)}


def test_ties(spark):
    glyphs = spark.createDataFrame([("a", 0), ("b", 0xFFFF), ("c", 0x3FF), ("none", None)], "set_code string, glyph long")
    symbols = spark.createDataFrame([(1, 0b11), (2, None), (3, 0xFFFF), (4, 0x7F), (5, 0b1), (6, 1 << 40)], "k int, symbol long")
    tied = [(1, 10, "a"), (1, 11, "b"), (1, 9, "a"), (2, 10, "a"), (3, 12, "b"), (3, 13, "c"), (4, 14, "c"), (4, 15, "a"), (5, 16, "none"), (6, 17, "a"), (6, 18, "none")]
    out = V.ties_broken(symbols, spark.createDataFrame(tied, "k int, candidate int, set_code string"), glyphs, "k")
    # 3: c is only 6 bits behind b; 4: both within 3 and 7; 5: no glyph; 6 is near by one bit and has no rival.
    assert sorted(map(tuple, out.collect())) == [(1, 9), (6, 17)]


def test_second_pass(spark):
    withheld = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    winners = spark.createDataFrame([(1, 7), (2, None), (9, 7)], "k int, winner int")
    out = V.recovered_frames(withheld, winners, spark.createDataFrame([(7, "Ann Lee")], "pk int, artist string"), "k")
    assert sorted(map(tuple, out.collect())) == [(1, "artist", "Ann Lee", 0.8), (1, "tag", "altered-frame", 0.7)]


def test_elimination(spark):
    open_rows = spark.createDataFrame([("one", 1), ("two", 2), ("two", 3), ("unseen", 4), ("border", 5), ("frame", 6), ("many", 7), ("blank", 8)], "name string, k int")
    uncovered = spark.createDataFrame([("one", 10, "black", "2015"), ("two", 11, "black", "2015"), ("unseen", 12, "black", "2015"), ("border", 13, "black", "2015"), ("frame", 14, "black", "1993"), ("many", 15, "black", "1993"), ("many", 16, "black", "1993"), ("blank", 17, None, None)], "name string, printing int, border string, frame string")
    evidence = spark.createDataFrame([(1, "black", "modern"), (2, "black", "modern"), (5, "white", "modern"), (6, "black", "modern"), (7, "black", "old"), (8, "", "")], "k int, border string, frame string")
    out = {r.k: (r.printing, r.reason) for r in V.eliminated(open_rows, uncovered, evidence, "name", "k").collect()}
    assert out == {1: (10, ""), 4: (None, "no-evidence"), 5: (None, "border-mismatch"), 6: (None, "frame-mismatch"), 8: (17, "")}


def test_sort_modes(spark):
    rows = [(1, "b", 3, None), (2, "a", 3, 5), (3, "c", None, 1), (4, "a", 1, 9), (5, None, 2, 2)]
    df = spark.createDataFrame(rows, "pk int, name string, made int, changed int")
    columns = {"name": "name", "date_created": "made", "date_modified": "changed"}
    order = {m: [r.pk for r in S.explored(df, m, 0, 10, columns, "pk").orderBy("place").collect()] for m in S.SORTS}
    assert order == {"nameAscending": [2, 4, 1, 3, 5], "nameDescending": [3, 1, 2, 4, 5], "dateCreatedAscending": [4, 5, 2, 1, 3], "dateCreatedDescending": [2, 1, 5, 4, 3], "dateModifiedAscending": [3, 5, 2, 4, 1], "dateModifiedDescending": [4, 2, 5, 3, 1]}
    assert [tuple(r) for r in S.explored(df, "nameAscending", 1, 2, columns, "pk").orderBy("place").collect()] == [(4, 2, 5), (1, 3, 5)]
    assert S.explored(df, "nameAscending", 9, 2, columns, "pk").count() == 0
    for bad in (("size", 0, 1), ("nameAscending", -1, 1), ("nameAscending", 0, 0), ("nameAscending", 0, 101)):
        with pytest.raises(ValueError):
            S.explored(df, *bad, columns, "pk")
