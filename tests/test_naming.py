"""Names of uploaded files, learnt aliases, deck lines and readings of small print, on small scenarios."""

from difflib import SequenceMatcher

from lodeframe.functions import text as T
from lodeframe.functions.similarity import indel_ratio
from lodeframe.operators import naming as N
from pyspark.sql import functions as F


def tables(spark):
    printings = spark.createDataFrame([(1, "lea", "012"), (2, "m10", "012"), (3, "lea", "100")], "pk long, set_code string, number string")
    artists = spark.createDataFrame([(10, "Ann Lee"), (11, "Bo Ray")], "pk long, name string")
    codes = spark.createDataFrame([("lea",), ("m10",), ("zzz",)], "code string")
    tags = spark.createDataFrame([(20, "Full Art", ["fullart", "FA"], 21), (21, "Art Style", [], None), (22, "Foil", ["shiny"], None), (23, "Etched", ["foil"], 22)], "pk long, name string, aliases array<string>, parent_pk long")
    return printings, artists, codes, tags


def test_cascade_of_a_name(spark):
    names = {
        "Ring [LEA 012, Foil]": ("Ring", 1, None, None, ["Foil"]),
        "Ring {100} [LEA] (shiny)": ("Ring [LEA]", 3, None, None, ["Foil"]),
        "Ring (Ann Lee) [FULLART]": ("Ring", None, 10, None, ["Art Style", "Full Art"]),
        "Ring [LEA, M10] (Ann Lee, Bo Ray)": ("Ring [M10] (Ann Lee, Bo Ray)", None, None, "lea", []),
        "Ring [LEA 012] (M10 012)": ("Ring [LEA 012] (M10 012)", None, None, None, []),
        "Ring [zzz, other]": ("Ring [other]", None, None, "zzz", []),
        "Ring [Foil, Foil] (Foil)": ("Ring", None, None, None, ["Foil"]),
        "Ring [Etched]": ("Ring", None, None, None, ["Etched", "Foil"]),
        "Plain  Ring": ("Plain Ring", None, None, None, []),
    }
    df = spark.createDataFrame(list(enumerate(names)), "pk int, name string")
    out = {r.pk: (r.bare, r.card_pk, r.artist_pk, r.hint, r.tags) for r in N.extracted(df, "pk", "name", *tables(spark)).collect()}
    assert out == dict(enumerate(names.values()))
    learnt = spark.createDataFrame([("Fool Art", 20)], "raw string, tag_pk long")
    one = spark.createDataFrame([(1, "Ring [fool art]")], "pk int, name string")
    assert [(r.bare, r.tags) for r in N.extracted(one, "pk", "name", *tables(spark), learnt).collect()] == [("Ring", ["Art Style", "Full Art"])]


def test_suggestions_keep_their_state(spark):
    tags = tables(spark)[3]
    raws = ["Ful Art"] * 3 + ["Fooil Art", "Etchd", "Foill", "foil", "qqqqqq", "Shinny", "Old"]
    stored = [("Etchd", 23, 0.9, 4, "REJECTED"), ("Foill", 22, 0.7, 2, "PENDING"), ("Shinny", 22, 0.95, 1, "AUTO_ACCEPTED"), ("Kept", 22, 0.7, 1, "PENDING")]
    df = spark.createDataFrame([(x,) for x in raws], "raw string")
    out = {r.raw: (r.tag_pk, r.occurrences, r.status) for r in N.suggested(df, tags, spark.createDataFrame(stored, "raw string, tag_pk long, ratio double, occurrences long, status string")).collect()}

    def expected(raw):
        texts = [(pk, x) for pk, n, a, _ in (tuple(r) for r in tags.collect()) for x in [n, *a]]
        best = max((indel_ratio(raw.lower(), x.lower()), -pk) for pk, x in texts)
        return (-best[1], "AUTO_ACCEPTED" if best[0] >= N.ALIAS else "PENDING") if best[0] >= N.SUGGESTION else None

    assert out["Ful Art"] == (20, 3, "AUTO_ACCEPTED") and out["Etchd"] == (23, 4, "REJECTED") and out["Kept"] == (22, 1, "PENDING")
    assert out["Foill"][1] == 3 and out["Shinny"][1:] == (2, "AUTO_ACCEPTED") and "foil" not in out and "qqqqqq" not in out
    assert out["Fooil Art"] == (expected("Fooil Art")[0], 1, expected("Fooil Art")[1]) and ("Old" in out) == (expected("Old") is not None)


def test_deck_lines_with_images_and_back_faces(spark):
    lines = {
        "3x t:Goblin@abc-1 // Bird [mpc:xyz]": (3, "TOKEN", "Goblin", "abc-1", "Bird", "xyz", None, None),
        "Day Walker": (1, "CARD", "Day Walker", None, "Night Walker", None, None, None),
        "2 DAY walker! [mpc:one]@two (SET) 12": (2, "CARD", "DAY walker!", "one", "Night Walker", None, "SET", "12"),
        "b:Back@1": (1, "CARDBACK", "Back", "1", None, None, None, None),
    }
    df = spark.createDataFrame(list(enumerate(lines)), "pk int, line string").select("pk", T.deck_line(F.col("line")).alias("d")).select("pk", "d.*")
    pairs = spark.createDataFrame([("Day Walker", "Night Walker")], "front string, back string")
    out = {r.pk: (r.quantity, r.kind, r.front, r.front_id, r.back, r.back_id, r.set_code, r.number) for r in N.with_back_faces(df, pairs).collect()}
    assert out == dict(enumerate(lines.values()))


def test_readings_of_small_print(spark):
    names = ["Ann Leeson", "Bob van der Berg", "Annika Leeds", "Carla Moritz", *(f"Common Start {x}" for x in "abcdefgh")]
    lexicon = spark.createDataFrame([(n,) for n in names], "artist string")
    lines = {1: "012/250 C SET EN Ann Leeson", 2: "R 2015 Bob van der Berq TM", 3: "0123 Carla Mor", 4: "nothing to read here", 5: "xx Common Start", 6: "Annika Leeds Carla Moritz"}
    df = spark.createDataFrame(list(lines.items()), "k int, line string")
    out = {r.k: r.entry for r in N.recovered(df, "k", "line", lexicon, "artist").collect()}
    assert out == {1: "Ann Leeson", 2: "Bob van der Berg", 3: "Carla Moritz"} and SequenceMatcher(None, "bobvanderberq", "bobvanderberg").ratio() > N.READING
    own = spark.createDataFrame([(6, "Carla Moritz"), (1, "Annika Leeds")], "k int, artist string")
    out = {r.k: r.entry for r in N.recovered(df, "k", "line", lexicon, "artist", own).collect()}
    assert out[6] == "Carla Moritz" and 1 not in out and out[2] == "Bob van der Berg"


def test_any_number_of_a_tag_leaves(spark):
    text = "Ring [" + ", ".join(["a.b"] * 30) + ", keep] (a.b)"
    df = spark.createDataFrame([(text, "a.b"), ("x [axb]", "a.b"), ("x (y)", "")], "t string, g string")
    assert [r[0] for r in df.select(T.without_tag(F.col("t"), F.col("g"))).collect()] == ["Ring [keep]", "x [axb]", "x (y)"]


def test_letters_fold_by_their_decomposition(spark):
    df = spark.createDataFrame([("Őšł ÀÿẤ Ǆ ά ё e\u0301 Æß Ø plain",)], "t string")
    r = df.select(T.folded(F.col("t")).alias("a"), T.without_accents(F.col("t")).alias("b")).first()
    assert r.b == "Osł AyA Ǆ α е e Æß Ø plain" and r.a == "osl aya ǆ α е e aess o plain"
