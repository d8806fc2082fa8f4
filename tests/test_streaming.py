import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lodeframe.streaming import claims as C
from lodeframe.streaming import conveyor as V
from lodeframe.streaming import state as K


def test_batches_resume_and_replay_without_repeats(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = lambda a, b: spark.range(a, b).select("id", (F.col("id") % 3).alias("g")).coalesce(1)
    rows(0, 10).write.parquet(source)
    schema = rows(0, 1).schema
    step = lambda b: b.where("g = 1")
    V.convey(V.change_stream(spark, source, schema), step, out, cp)
    V.convey(V.change_stream(spark, source, schema), step, out, cp)  # nothing new
    rows(10, 20).write.mode("append").parquet(source)
    V.convey(V.change_stream(spark, source, schema), step, out, cp)
    assert sorted(r.id for r in V.results(spark, out).collect()) == [1, 4, 7, 10, 13, 16, 19]
    ledger = V.ledger(spark, out).where("status = 'completed'").agg(F.sum("rows_in"), F.sum("rows_out")).first()
    assert tuple(ledger) == (20, 7)
    # A fresh checkpoint numbers batches anew and overwrites their results.
    V.convey(V.change_stream(spark, source, schema), step, out, str(tmp_path / "cp2"))
    assert V.results(spark, out).where("batch_id = 0").count() == 7


def test_halted_batch_writes_its_ledger_row_alone(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)
    V.convey(V.change_stream(spark, source, spark.range(1).schema), lambda b: b, out, str(tmp_path / "cp"), most_rows=2)
    assert [(r.status, r.rows_in, r.rows_out) for r in V.ledger(spark, out).collect()] == [("halted", 5, 0)]


def test_cursor_wraps_and_laps(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert [r.k for r in V.cursor_walk(rows, "k", 7, 5).collect()] == [8, 9, 0, 1, 2]
    assert V.lap_complete(rows.withColumn("found", F.lit(False))).first().drained


def test_versions_of_a_cursor_are_made_once(spark, tmp_path):
    cursor = C.Cursor(str(tmp_path), "c")
    start = cursor.read()
    assert start == C.Mark() and cursor.advance(start, 10, "ann") and not cursor.advance(start, 20, "bob")
    mark = cursor.read()
    assert (mark.version, mark.position, mark.wraps, mark.worker) == (1, 10, 0, "ann")
    with pytest.raises(ValueError):
        cursor.advance(mark, 10, "ann")
    assert cursor.wrap(mark, "bob") and not cursor.wrap(mark, "ann") and (cursor.read().position, cursor.read().wraps) == (None, 1)
    assert [m.worker for m in cursor.history()] == ["ann", "bob"] and not list(tmp_path.glob("c/.*"))
    through_spark = C.Cursor(tmp_path.as_uri(), "c", spark)
    assert through_spark.read() == cursor.read()


def test_a_walk_claims_what_it_uses_and_stops_at_the_wrap(spark, tmp_path):
    rows = spark.range(1, 101).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,)], "k long"))
    cursor = C.Cursor(str(tmp_path), "c")
    even = F.when(F.col("k") > 1, F.col("k") % 2 == 0)  # null for the first
    walk = C.claimed(rows, "k", cursor, "ann", even, limit=5, chunk=30)
    assert walk == C.Walk([2, 4, 6, 8, 10], False, 10, 0) and cursor.read().position == 10  # not the whole chunk
    walk = C.claimed(rows, "k", cursor, "ann", F.col("k") > 95, limit=5, chunk=30, cap=50)
    assert (walk.found, walk.examined, cursor.read().position) == ([], 50, 60)  # the cap ends it
    walk = C.claimed(rows, "k", cursor, "ann", F.col("k") > 95, limit=50, chunk=30)
    assert (walk.found, walk.lap_ended, cursor.read().position, cursor.read().wraps) == ([96, 97, 98, 99, 100], True, None, 1)
    assert C.claimed(rows, "k", cursor, "ann", even, limit=5, lap=0) == C.Walk([], True, 0, 0)  # that lap is over
    assert C.claimed(rows.where("k < 0"), "k", cursor, "ann", even, limit=5).lap_ended


def test_a_lost_claim_is_dropped(spark, tmp_path):
    rows = spark.range(1, 21).withColumnRenamed("id", "k")

    class Beaten(C.Cursor):
        rival = True

        def advance(self, seen, position, worker):
            if self.rival:
                self.rival = False
                super().advance(seen, 7, "rival")
            return super().advance(seen, position, worker)

    walk = C.claimed(rows, "k", Beaten(str(tmp_path), "c"), "ann", F.lit(True), limit=5)
    assert (walk.found, walk.lost) == ([8, 9, 10, 11, 12], 1)


RACER = """
import sys
from pyspark.sql import functions as F
from lodeframe.session import session
from lodeframe.streaming import claims as C
folder, worker = sys.argv[1:]
spark = session(worker, master="local[1]", shuffle_partitions=1, memory="512m")
rows, cursor = spark.read.parquet(f"{folder}/rows"), C.Cursor(folder, "cursor")
open(f"{folder}/{worker}", "w").close()
import os, time
while not (os.path.exists(f"{folder}/ann") and os.path.exists(f"{folder}/bob")):
    time.sleep(0.05)
walk = C.Walk([], False, 0, 0)
while not walk.lap_ended:
    walk = C.claimed(rows, "k", cursor, worker, F.col("k") % 3 != 0, 40, 50, 200, retries=1000, lap=0)
    print(*walk.found)
"""


def test_two_processes_get_disjoint_ranges(spark, tmp_path):
    spark.range(1, 2001).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "rows"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = lambda w: subprocess.Popen([sys.executable, "-c", RACER, str(tmp_path), w], cwd=root, env={**os.environ, "PYTHONPATH": root}, stdout=subprocess.PIPE, text=True)
    parts = [[int(x) for x in p.communicate(timeout=300)[0].split()] for p in [run("ann"), run("bob")]]
    assert all(parts) and not set(parts[0]) & set(parts[1])
    assert sorted(parts[0] + parts[1]) == [k for k in range(1, 2001) if k % 3]
    assert {m.worker for m in C.Cursor(str(tmp_path), "cursor").history()} == {"ann", "bob"}


def test_marks_never_fall_and_survive_a_restart(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    lots = [[("a", 5), ("b", 2), ("a", 3)], [("a", 4), ("b", 9), ("c", None)], [("a", 1), ("b", 8), (None, 3)]]
    kind = "scope string, position long"
    for lot in lots:
        spark.createDataFrame(lot, kind).coalesce(1).write.mode("append").parquet(source)
        K.advance_marks(V.change_stream(spark, source, spark.createDataFrame([], kind).schema, 1), "scope", "position", out, cp)
    assert {r.scope: r.position for r in K.marks(spark, out).collect()} == {"a": 5, "b": 9, None: 3}
    rows = V.results(spark, out).groupBy("scope").agg(F.count("*").alias("n"), F.max("n_rows").alias("seen")).collect()
    assert {r.scope: (r.n, r.seen) for r in rows} == {"a": (1, 2), "b": (2, 2), None: (1, 1)}  # older positions bring nothing out


def test_rings_keep_the_newest_as_one_run_does(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", "z", None]), rng.randrange(12), k) for k in range(200)] + [("x", None, 300), ("x", 5, None)]
    table = spark.createDataFrame(rows, "owner string, at long, pk long")
    want = {}
    for owner in ("x", "y", "z", None):
        own = sorted(((a, p) for o, a, p in rows if o == owner and a is not None and p is not None), reverse=True)[:5]
        want |= {(owner, k): p for k, (_, p) in enumerate(own, 1)}
    for name, lots in (("one", [table]), ("many", [table.where(F.pmod(F.xxhash64("pk"), F.lit(4)) == k) for k in range(4)])):
        source, out, cp = (str(tmp_path / name / x) for x in ("in", "out", "cp"))
        for lot in lots:
            lot.coalesce(1).write.mode("append").parquet(source)
            K.fill_rings(V.change_stream(spark, source, table.schema, 1), "owner", "at", "pk", out, cp)
        assert {(r.owner, r.place): r.pk for r in K.rings(spark, out).collect()} == want
