"""Whole runs that are killed, fail or are rehearsed, and what calculators, engines and equal pictures give."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import runs as R


def stages(seen, fail=None, gates=None):
    def step(name, f):
        def run(t):
            seen.append(name)
            if name == fail:
                raise OSError("lost")
            return f(t)

        return R.Stage(name, run, (gates or {}).get(name, {}))

    return [step("double", lambda t: t["rows"].select((F.col("id") * 2).alias("x"))), step("few", lambda t: t["double"].where("x > 6")), step("sum", lambda t: t["few"].agg(F.sum("x").alias("s")))]


def test_a_run_goes_on_behind_its_last_finished_stage(spark, tmp_path):
    folder, seen, inputs = str(tmp_path), [], {"rows": spark.range(10)}
    with pytest.raises(OSError):
        R.Run(spark, folder, "r", stages(seen, "sum")).go(inputs)
    assert seen == ["double", "few", "sum"]
    out = R.Run(spark, folder, "r", stages(seen)).go({"rows": spark.range(99)})  # finished stages are not computed anew
    assert seen == ["double", "few", "sum", "sum"] and out["sum"].first().s == sum(x for x in range(0, 20, 2) if x > 6)
    ledger = [(r.ordinal, r.stage, r.status, r.rows_out, r.detail) for r in R.Run(spark, folder, "r", stages(seen)).ledger().orderBy("finished_at").collect()]
    assert ledger == [(1, "double", "completed", 10, ""), (2, "few", "completed", 6, ""), (3, "sum", "failed", 0, "OSError"), (3, "sum", "completed", 1, "")]
    one = R.Run(spark, folder, "another", stages(seen)).go(inputs)
    assert all(one[k].exceptAll(out[k]).count() == 0 == out[k].exceptAll(one[k]).count() for k in out)


def test_rows_of_a_stage_without_its_ledger_row_are_computed_anew(spark, tmp_path):
    seen, inputs = [], {"rows": spark.range(10)}
    spark.range(3).select(F.col("id").alias("x")).write.parquet(f"{tmp_path}/r/double")  # killed before the ledger was written
    assert R.Run(spark, str(tmp_path), "r", stages(seen)).go(inputs)["double"].count() == 10 and seen[0] == "double"


def test_gates_and_preflight_halt(spark, tmp_path):
    seen, inputs = [], {"rows": spark.range(10)}
    gates = {"few": {"too large": lambda t: t["few"].where("x > 16")}}
    with pytest.raises(R.Halted, match="too large in few"):
        R.Run(spark, str(tmp_path), "r", stages(seen, gates=gates)).go(inputs)
    assert seen == ["double", "few"]
    run = R.Run(spark, str(tmp_path), "p", stages(seen), {"no rows": lambda t: t["rows"].where("id > 8")})
    with pytest.raises(R.Halted, match="no rows in preflight"):
        run.go(inputs)
    assert seen == ["double", "few"] and [tuple(r)[:5] for r in run.ledger().collect()] == [(0, "preflight", "failed", 0, "no rows")]
    with pytest.raises(R.Halted):
        run.rehearse(inputs)
    with pytest.raises(ValueError):
        R.Run(spark, str(tmp_path), "p", stages(seen) + stages(seen))


def test_a_rehearsal_writes_nothing(spark, tmp_path):
    run = R.Run(spark, str(tmp_path), "r", stages([]))
    assert run.rehearse({"rows": spark.range(10)}) == {"double": 10, "few": 6, "sum": 1}
    assert os.listdir(tmp_path) == [] and run.ledger().count() == 0


def test_counts_add_up(spark):
    rng = random.Random(4)
    judged = [(k, rng.choice(["a", "b", None]), None) for k in range(200)]
    judged = [(k, o, "" if o else rng.choice(["no-text", "ambiguous", None])) for k, o, _ in judged]
    stored = [(k, rng.choice("ab")) for k in range(0, 200, 3)] + [(3, "a"), (3, "b"), (999, "a")]
    rows, old = spark.createDataFrame(judged, "k int, o string, s string"), spark.createDataFrame(stored, "k int, outcome string")
    for dry in (False, True):
        n = {r.counter: r.n for r in R.calculator_counts(rows, old, "k", F.col("o"), F.col("s"), dry).collect()}
        new = "withheld" if dry else "written"
        assert n["considered"] == 200 == n["cast"] + sum(v for c, v in n.items() if c.startswith("skipped: "))
        assert n["cast"] == n[new] + n["already"] and n["already"] == sum((k, o) in set(stored) for k, o, _ in judged)
        assert set(n) == {"considered", "cast", "already", new, "skipped: no-text", "skipped: ambiguous", "skipped: "}
    assert R.calculator_counts(rows.limit(0), old, "k", F.col("o"), F.col("s")).count() == 0


def test_two_engines(spark):
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, None), (5, None)], "k int, outcome string")
    two = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c"), (5, None), (6, "d")], "k int, outcome string")
    assert sorted(map(tuple, R.two_engines(one, two, "k").collect())) == [(1, "a", "both", ""), (2, None, None, "engines-disagree"), (3, "a", "one", ""), (4, "c", "two", ""), (5, None, None, "no-engine"), (6, "d", "two", "")]


def test_equal_pictures_share_verdicts(spark):
    rows = [(1, "m1", 7), (2, "m1", 7), (3, "m1", 8), (4, "m2", 7), (5, "m2", 9), (6, "", 9), (7, None, None), (8, "", None), (9, "m3", 8), (10, "m4", 5), (11, "m4", 5), (12, "m4", 6), (13, "m5", 6)]
    verdicts = [(1, "x"), (5, "y"), (10, "p"), (11, "q"), (13, "z")]
    given, conflicts = R.shared_verdicts(spark.createDataFrame(rows, "k int, md5 string, h int"), spark.createDataFrame(verdicts, "k int, outcome string"), "k", ["md5", "h"])
    # 4 takes its checksum's verdict, not its hash's; 12 is of a torn group by checksum, so its hash decides.
    assert sorted(map(tuple, given.collect())) == [(2, "x", 1, "md5"), (3, "x", 1, "md5"), (4, "y", 5, "md5"), (6, "y", 5, "h"), (12, "z", 13, "h")]
    assert sorted(map(tuple, conflicts.collect())) == [("h", "5", 2), ("md5", "m4", 2)]
