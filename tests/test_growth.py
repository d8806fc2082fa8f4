"""What a query holds or reads must not grow faster than its input."""

from pyspark.sql import functions as F

from lodeframe.operators import fields as P
from lodeframe.plans import QUERIES
from lodeframe.streaming import claims as C

SMALL = "/root/testdata/sf0.001"


def test_intersection_meets_by_counts(spark):
    """Rows are aggregated before the shuffle, of both sides: no task holds all rows of a key, as one of a join does."""
    plan = QUERIES["set_4_intersection"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_a_lap_of_many_chunks_reads_few_stretches(spark, tmp_path):
    """Chunks come from a stretch read ahead, whoever moves the cursor, and each key is claimed once."""
    rows = spark.range(1000).selectExpr("id as k").unionByName(spark.createDataFrame([(None,)], "k long"))
    ahead = [C.Ahead(rows, "k", F.col("k") % 2 == 0) for _ in range(2)]
    cursors, keys, turn, ended = [C.Cursor(str(tmp_path), "c") for _ in range(2)], [], 0, False
    for a in ahead:
        a.STRETCH = 300
    while not ended:
        walk = C.claimed(ahead[turn], "k", cursors[turn], str(turn), F.lit(True), 7, 10, 30, lap=0)
        keys, ended, turn = keys + walk.found, walk.lap_ended, 1 - turn
    assert keys == list(range(0, 1000, 2)) and all(a.reads <= 5 for a in ahead)
    assert cursors[0].read() == cursors[1].read() == C.Cursor(str(tmp_path), "c").history()[-1]


def test_pictures_are_drawn_by_batches(spark):
    """Cells come from array indices, not from an expression for each cell; a band's sums take one pass."""
    plan = QUERIES["img_5_border_color"](spark, SMALL)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "sequence(" in plan and "2239" not in plan
    rows = spark.createDataFrame([([3, 4, 5],), (None,)], "v array<int>").select(P.moments(F.col("v")).alias("m"))
    assert [(r.m and (r.m.n, r.m.sum, r.m.squares)) for r in rows.collect()] == [(3, 12, 50), None]
    assert rows._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
