"""Connected components by alternating large-star and small-star rounds.

All work is joins and pre-aggregated minima over edges; nothing reaches the driver but one
row of counts a round.  Rows of one hub are a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    far = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return far.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Self-loops, repeated and reversed edges change nothing; edges with a null end are no edges.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.least(a, b).alias("b"), F.greatest(a, b).alias("a")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).select("a", "b").distinct(), "edges")
    stamp = None
    while True:
        new = written(_small_star(_large_star(now)), "edges")
        dropped(spark, now)
        n, total = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = new
        if (n, total) == stamp or not n:
            break
        stamp = (n, total)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
