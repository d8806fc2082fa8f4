"""The sink of search documents: what failed tasks, failed updates and rival writers leave."""

import logging
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lodeframe.sources import index as X


def docs(spark, n, first=0):
    return spark.range(first, first + n).select(F.concat(F.lit("d"), "id").alias("identifier"), F.col("id").alias("n"), F.array(F.lit("a"), F.col("id").cast("string")).alias("tags"))


def shown(spark, path):
    out = X.indexed(spark, path, docs(spark, 1).schema, "identifier")
    return {r.identifier: r.n for r in out.collect()}


def data_files(path):
    import glob

    return sorted(glob.glob(f"{path}/data/*"))


def test_documents_are_written_by_shard_and_read_back(spark, tmp_path):
    path = str(tmp_path / "index")
    assert shown(spark, path) == {}
    X.index_documents(docs(spark, 100).repartition(3), path, "identifier")
    out = X.indexed(spark, path, docs(spark, 1).schema, "identifier")
    assert out.exceptAll(docs(spark, 100)).count() == 0 and out.count() == 100
    assert {int(f.rsplit("/", 1)[1].split("-")[0]) for f in data_files(path)} == set(range(X.SHARDS))
    X.index_documents(docs(spark, 3), path, "identifier")  # a new index hides the old one
    assert shown(spark, path) == {"d0": 0, "d1": 1, "d2": 2}


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "index")
    X.index_documents(docs(spark, 10), path, "identifier")
    before, files = shown(spark, path), data_files(path)
    bad = docs(spark, 40, 100).withColumn("identifier", F.when(F.col("n") != 137, F.col("identifier"))).repartition(4, "n")
    for write in (lambda: X.index_documents(bad, path, "identifier"), lambda: X.index_documents(docs(spark, 40, 100).withColumn("n", F.when(F.col("n") == 120, F.raise_error(F.lit("lost"))).otherwise(F.col("n"))), path, "identifier")):
        with pytest.raises(Exception, match="a document has no identifier|lost"):
            write()
        assert shown(spark, path) == before
    assert set(files) <= set(data_files(path)) and X.Folder(path).manifest()[0] == 1


def test_updates_and_removals_never_raise(spark, tmp_path, caplog):
    path = str(tmp_path / "index")
    X.index_documents(docs(spark, 5), path, "identifier")
    changed = docs(spark, 2).withColumn("n", F.col("n") + 70)
    assert X.reindexed(changed, path, "identifier") and shown(spark, path) == {"d0": 70, "d1": 71, "d2": 2, "d3": 3, "d4": 4}
    assert X.removed(docs(spark, 1), path, "identifier") and X.removed(docs(spark, 1, 99), path, "identifier")
    assert X.reindexed(docs(spark, 1, 4).withColumn("n", F.lit(7).cast("long")), path, "identifier") and X.reindexed(docs(spark, 1, 4).withColumn("n", F.lit(8).cast("long")), path, "identifier")
    assert shown(spark, path) == {"d1": 71, "d2": 2, "d3": 3, "d4": 8}
    with caplog.at_level(logging.ERROR):
        assert not X.reindexed(changed.withColumn("identifier", F.lit(None).cast("string")), path, "identifier")
        assert not X.removed(changed.select(F.lit(None).cast("string").alias("identifier")), path, "identifier")
    assert len([r for r in caplog.records if "failed" in r.message]) == 2
    assert shown(spark, path) == {"d1": 71, "d2": 2, "d3": 3, "d4": 8}
    assert X.reindexed(docs(spark, 1), path, "identifier") and shown(spark, path)["d0"] == 0  # a removed document comes back


def test_rival_writers_both_count(spark, tmp_path):
    path = str(tmp_path / "index")
    X.index_documents(docs(spark, 1), path, "identifier")
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(lambda k: X.reindexed(docs(spark, 2, 10 * k), path, "identifier"), range(1, 5)))
    assert shown(spark, path) == {"d0": 0, **{f"d{10 * k + j}": 10 * k + j for k in range(1, 5) for j in (0, 1)}}
    assert X.Folder(path).manifest()[0] == 5


def test_manifests_are_made_once(tmp_path):
    folder = X.Folder(str(tmp_path / "index"))
    assert folder.publish(1, [(1, "a")]) and not folder.publish(1, [(1, "b")]) and folder.manifest() == (1, [(1, "a")])
