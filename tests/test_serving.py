"""Serving policy against a plain loop, table functions in SQL, and hashes of searches."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lodeframe.functions import tables
from lodeframe.functions import text as T
from lodeframe.operators import serving as Q


def plain(pool, excluded, log, voter, draws, target):
    """One draw after the other, each looking at the log as it then is."""
    gone = {c for v, c in excluded if v == voter}
    served, out = [lane for v, lane in log if v == voter], []
    for n in range(1, draws + 1):
        share = served.count("likely") / len(served) if served else 0.0
        lanes = (["likely"] if share < target else []) + ["confirm", "contested", "fresh"]
        for lane in lanes:
            left = [c for c in pool.get(lane, []) if c not in gone]
            if left:
                gone.add(left[0])
                served.append(lane)
                out.append((voter, n, lane, left[0], round(share, 9)))
                break
        else:
            return out
    return out


def test_draws_equal_a_plain_loop(spark):
    rng = random.Random(9)
    cards = [(k, rng.choice(["likely", "likely", "confirm", "contested", "fresh"]), rng.randrange(5)) for k in range(90)]
    pool = {}
    for k, lane, p in sorted(cards, key=lambda c: (-c[2], c[0])):
        if len(pool.setdefault(lane, [])) < 12:
            pool[lane].append(k)
    voters = [f"v{k}" for k in range(12)] + ["new", None]
    excluded = [(v, rng.randrange(90)) for v in voters[:12] for _ in range(rng.randrange(0, 80))]
    excluded += excluded[:20]
    log = [(v, rng.choice(["likely", "fresh", "fresh"])) for v in voters[:9] for _ in range(rng.randrange(0, 8))]
    table = spark.createDataFrame(cards, "card int, lane string, priority int")
    pooled = Q.pooled(table, "card", "lane", [F.desc("priority"), "card"], 12)
    assert {(r.lane, r.place): r.card for r in pooled.collect()} == {(lane, n): c for lane, own in pool.items() for n, c in enumerate(own, 1)}
    for target in (0.0, 0.51, 1.0):
        out = Q.drawn(spark.createDataFrame([(v,) for v in voters], "voter string"), pooled, spark.createDataFrame(excluded, "voter string, card int"), spark.createDataFrame(log, "voter string, lane string"), 50, target)
        found = sorted(((r.voter, r.draw, r.lane, r.card, round(r.share, 9)) for r in out.collect()), key=str)
        assert found == sorted((x for v in voters for x in plain(pool, excluded, log, v, 50, target)), key=str)


def test_without_pools_or_voters(spark):
    none = lambda s: spark.createDataFrame([], s)
    pool, voters = none("lane string, place int, card int"), spark.createDataFrame([("a",)], "voter string")
    assert Q.drawn(voters, pool, none("voter string, card int"), none("voter string, lane string"), 5).count() == 0
    assert Q.drawn(none("voter string"), pool, none("voter string, card int"), none("voter string, lane string"), 5).count() == 0


def test_deck_lines_of_sql(spark):
    tables.register(spark)
    decks = [(1, "3x Front // Back\n\n  2 Plain  \r\nx marks\n1 |"), (2, None), (3, ""), (4, "4X A|B"), (None, "12 é ü"), (5, " \n//only back")]
    rows = spark.sql("select * from deck_lines(table(select k, deck from {d}))", d=spark.createDataFrame(decks, "k bigint, deck string")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 1, 3, "Front", "Back"), (1, 3, 2, "Plain", None), (1, 4, 1, "x marks", None), (1, 5, 1, "", None), (4, 1, 4, "A", "B"), (None, 1, 12, "é ü", None), (5, 2, 1, "", "only back")], key=str)


def test_deck_lines_of_slices():
    batch = pa.record_batch({"id": pa.array([1, 2, 3]), "deck": pa.array(["a\nb", "2 c\n\nd", "e"])}).slice(1)
    (out,) = tables.DeckLines().eval(batch)
    assert list(zip(*[c.to_pylist() for c in out.columns], strict=True)) == [(2, 1, 2, "c", None), (2, 3, 1, "d", None), (3, 1, 1, "e", None)]


def test_candidates_of_sql_become_a_join(spark):
    printings = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", 1), (4, None, 2)], "pk bigint, name string, popularity bigint")
    tables.register(spark, printings)
    cards = spark.createDataFrame([(10, "a"), (11, "zz"), (12, None), (13, "b")], "pk bigint, name string")
    out = spark.sql("select c.pk, k.* from {c} c, lateral candidates_of(c.name) k", c=cards)
    assert sorted(map(tuple, out.collect()), key=str) == [(10, 1, 5), (10, 2, None), (13, 3, 1)]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_hashes_of_code_units(spark):
    rows = ["", "a", "ab", "é", "日本", "\U0001f600 x", "￿", "x" * 5000, None]
    assert T.fnv1a("") == 2166136261 and T.fnv1a("a") == 0xE40C292C and T.fnv1a("foobar") == 0xBF9CF968
    table = spark.createDataFrame(list(enumerate(rows)), "k int, s string")
    assert {r.k: r.h for r in table.select("k", T.fnv1a_hash(F.col("s")).alias("h")).collect()} == {k: T.fnv1a(s) if s is not None else None for k, s in enumerate(rows)}
    key = table.select(T.query_key(F.lit("CARD"), F.col("s"), F.lit(None).cast("string"), F.lit("7")).alias("k")).first().k
    assert key == str(T.fnv1a("cardType=CARD\n  &query=\n  &expansionCode=null\n  &collectorNumber=7"))
