import gzip
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.operators import search as S
from lodeframe.operators import sync as Y
from lodeframe.operators import verdicts as V
from lodeframe.sources import files as R
from lodeframe.sources import listing


def test_diff(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "x", 1), (4, "d", 1)], "k int, s string, n int")
    got = {r.k: r.op for r in Y.diffed(old, new, "k", ["s", "n"]).collect()}
    assert got == {1: "unchanged", 2: "updated", 3: "deleted", 4: "created"}


def test_replacement_is_idempotent(spark):
    schema = "card int, agent string, outcome string"
    old = spark.createDataFrame([(1, "calc-v1", "a"), (2, "calc-v1", "b"), (1, "user", "c"), (1, None, "d")], schema)
    new = spark.createDataFrame([(1, "calc-v2", "z")], schema)
    once, archive = Y.replaced(old, new, ["card"], "calc", "run2")
    twice, _ = Y.replaced(once, new, ["card"], "calc", "run2")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(once) == rows(twice) and once.count() == 4
    assert [(r.agent, r.superseded_by_run_id) for r in archive.collect()] == [("calc-v1", "run2")]


def test_backfill_never_overwrites(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, None)], "k int, v int")
    got = {r.k: r.v for r in Y.backfilled(rows, spark.createDataFrame([(1, 9), (2, 9)], "k int, v int"), "k", ["v"]).collect()}
    assert got == {1: 9, 2: 5, 3: None}


def test_json_lines_files(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    lines = ["[", '{"id": "a", "n": 1},', "", '{"id": "b"}', "{broken", "]"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    with gzip.open(tmp_path / "y.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": "c", "n": 3}) + "\n")
    good, bad = R.valid_rows(R.read_json_lines(spark, str(tmp_path), schema), ["id"], {"n": 0})
    assert sorted((r.id, r.n) for r in good.collect()) == [("a", 1), ("b", 0), ("c", 3)] and bad.count() == 1


def test_orders_csv_and_folders(spark, tmp_path):
    (tmp_path / "orders").mkdir()
    (tmp_path / "orders" / "o.xml").write_text("<order><card><id>x</id><slots>1, 2</slots></card><card><id>y</id><slots>7</slots></card></order>")
    assert sorted((r.id, r.slot) for r in R.read_orders(spark, str(tmp_path / "orders")).collect()) == [("x", 1), ("x", 2), ("y", 7)]
    src = spark.createDataFrame([("k1", "n", "i", "LOCAL_FILE", None, "d")], R.SOURCES)
    R.write_csv(src, str(tmp_path / "csv"))
    assert R.read_sources(spark, str(tmp_path / "csv")).collect() == src.collect()
    for p in ("a/f.png", "!b/g.png", "a/!c/h.png"):
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_bytes(b"12")
    assert [(r.name, r.size) for r in R.scan_folder(spark, str(tmp_path / "tree")).collect()] == [("f.png", 2)]
    listing.register(spark)
    assert [r.name for r in spark.read.format("listing").option("path", str(tmp_path / "tree")).load().collect()] == ["f.png"]


def test_new_groups_are_kept_or_left_whole(spark):
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], "k int, o string")
    old = spark.createDataFrame([(1, "a"), (2, "a")], "k int, o string")
    assert sorted((r.k, r.o) for r in V.new_groups(new, old, ["k"], "o").collect()) == [(1, "a"), (1, "b"), (3, "a")]


def test_verdict_ladder(spark):
    df = spark.createDataFrame([(5, "", "s1"), (None, "no-match", "zz"), (None, "no-match", ""), (None, "ambiguous", "s1"), (5, "", "")], "m int, r string, s string")
    got = [tuple(x.v) for x in df.select(V.join_key_verdict(F.col("m"), F.col("r"), F.col("s"), ["s1"]).alias("v")).collect()]
    assert got == [("5", 0.85, ""), (None, None, "unknown-set-code"), ("NO_MATCH", 0.6, ""), (None, None, "ambiguous"), ("5", 0.75, "")]


def test_search_filters(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, ["a", "b", "c"]), (4, ["x"])], "k int, tags array<string>")
    got = sorted(r.k for r in df.where(S.tags_related(F.col("tags"), ["a", "b"], ["x"])).collect())
    assert got == [1, 2, 3]
    hits = spark.createDataFrame([("q1", 1)], "q string, k int")
    more = spark.createDataFrame([("q1", 2), ("q2", 3)], "q string, k int")
    assert sorted(tuple(r) for r in S.degraded(hits, more, "q").collect()) == [("q1", 1, False), ("q2", 3, True)]
