import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.functions import similarity as S
from lodeframe.functions import text as T
from lodeframe.operators import imaging as M


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v")).alias("x")).collect()]


def test_searchable(spark):
    assert one(spark, T.searchable, "Fire-Breath (Alt) [x] 12!", "", None, "It’s  A  Test", "  a\tb ") == ["fire breath", "", "", "its a test", "a b"]


def test_client_searchable_replaces_only_the_first(spark):
    assert one(spark, T.client_searchable, "Á-b-c", "ñandú") == ["a bc", "nandu"]


@pytest.mark.parametrize(
    "raw, text, terms, errors",
    [
        ("plain words", "plain words", [], []),
        ("", "", [], []),
        (None, "", [], []),
        ("a:guay set:abc", "", [("artist", "guay", False), ("set", "abc", False)], []),
        ('-tag:"Full Art" x', "x", [("tag", "Full Art", True)], []),
        ('tag:""', "", [("tag", "", False)], []),
        ("power:4 y", "y", [], ["power"]),
        ("BORDER:black border:white", "", [("border", "black", False), ("border", "white", False)], []),
        ("word: x", "word: x", [], []),
        ("m2:x", "m2:x", [], []),
        ('tag:"open end', "end", [("tag", '"open', False)], []),
    ],
)
def test_query_parser(raw, text, terms, errors):
    q = T.parse_query(raw)
    assert (q.text, [(t.operator, t.value, t.negated) for t in q.terms], q.errors) == (text, terms, errors)


def test_batch_terms(spark):
    got = one(spark, lambda c: F.to_json(T.query_terms(c)), 'x -a:bob tag:"Full Art" power:3')
    assert got == ['[{"negated":true,"operator":"artist","value":"bob"},{"negated":false,"operator":"tag","value":"Full Art"}]']
    assert one(spark, T.residual_text, 'x -a:bob y tag:"Full Art"') == ["x y"]


def test_tags_and_suffixes(spark):
    assert one(spark, lambda c: F.array_join(T.tag_parts(c), "|"), "A (b, c) [d]", "none") == ["b|c|d", ""]
    assert one(spark, lambda c: T.without_tag(c, "b"), "A (b, c) [d]", "A (b)") == ["A (c) [d]", "A"]
    assert one(spark, T.without_copy_suffix, "N (1) - Copy", "N (x)", "N") == ["N", "N (x)", "N"]
    assert one(spark, T.interior_capital, "VazalTheGreat (2)", "vazal", "Two Words") == [True, False, False]
    assert one(spark, T.brace_number, "n {12}", "n") == ["12", None]


def test_small_print(spark):
    assert one(spark, T.copyright_year, "© 2015 x 1999", "made 1997", "none") == ["2015", "1997", None]
    assert one(spark, T.artist_credit, "Illus. Ann Lee.", "x") == ["Ann Lee", None]
    assert one(spark, T.boilerplate_key, "TM & © 2015 Printers", "4", "....!!!!......!!!!abcdefghijkl") == ["tm2015printers", None, None]
    got = one(spark, lambda c: F.to_json(T.collector_line(c)), "123/264 R ABC . EN", "xy1 77 2019", "no number here")
    assert got == ['{"number":"123","set_code":"abc"}', '{"number":"77","set_code":"xy1"}', "{}"]


def test_declared_tags(spark):
    got = one(spark, lambda c: F.array_join(T.declared_tags(c), ","), "Bolt (Fullart)", "no black border", "black border white-bordered showcase", "Etched Champion")
    assert got == ["Full Art", "", "Showcase", ""]


def test_deck_lines(spark):
    got = one(spark, lambda c: F.to_json(T.deck_line(c)), "2x t:Goblin // Orc (ABC) 12a", "Island")
    assert got[0] == '{"quantity":2,"kind":"TOKEN","front":"Goblin","back":"Orc","set_code":"ABC","number":"12a"}'
    assert got[1] == '{"quantity":1,"kind":"CARD","front":"Island"}'


def test_similarity_against_brute_force():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in "12")
        want = 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert S.indel_ratio(a, b) == pytest.approx(want)
    assert S.near_substring("made by MidJ0urney bot", "midjourney") and not S.near_substring("midj00rney", "midjourney")
    assert not S.near_substring("dalx", "dall", 8)


def test_fnv_hash():
    assert T.fnv1a("") == 0x811C9DC5 and T.fnv1a("a") == 0xE40C292C


def test_near_markers_in_the_jvm(spark):
    texts = ["made by MidJ0urney bot", "midjourney", "midj00rney", "Mid-Journey!", "dalx", "dall", None, "", "xmidjourneyx", "midjurney", "éMIDJÖURNEYé", "midjourne"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for marker, least in (("midjourney", 8), ("dall", 8), ("dall", 3), ("a.b", 3)):
        assert {r.k: r.h for r in df.select("k", S.holds_near(F.col("t"), marker, least).alias("h")).collect()} == {k: S.near_substring(t, marker, least) for k, t in enumerate(texts)}


def test_picture_quality_of_a_batch_equals_one_by_one():
    rng = np.random.default_rng(3)
    fields = [*rng.normal(size=(20, 64)), np.ones(64), None, np.array([]), np.arange(8.0), np.arange(9.0), np.r_[rng.normal(size=48), np.zeros(16)], rng.integers(0, 3, 100)]
    for field, found in zip(fields, M.measured(fields).itertuples(index=False), strict=True):
        want = M.sharpness(field), M.grey_entropy(field), field is not None and M.truncated(field)
        assert found.truncated == want[2] and [x is None for x in found[:2]] == [x is None for x in want[:2]]
        assert all(a == pytest.approx(b) for a, b in zip(found[:2], want[:2], strict=True) if b is not None)
