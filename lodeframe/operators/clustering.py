"""Clusters and hierarchies: exact groups, components over shared values, and parent chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def exact_clusters(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Groups of two or more rows with one value; the smallest key stands for each.  Null never groups."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(key).alias("representative"), F.count("*").alias("n")).where("n > 1")


def ancestors(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, ancestor) for every node and all nodes above it, itself included, by doubling parent links.

    A chain of n links, whatever its length, takes log2(n) joins, each cut from its lineage by a
    written table.  A link to itself is none; longer cycles raise an error.
    """
    jump = checkpointed(rows.select(F.col(key).alias("n"), F.col(parent).alias("up")).where("up is not null and up <> n"))
    closure = rows.select(F.col(key).alias("n"), F.col(key).alias("a"))
    reach, nodes = 1, rows.count()
    while not jump.isEmpty():
        if reach > nodes:
            raise ValueError(f"{parent} links form a cycle")
        step = jump.select(F.col("n").alias("a"), F.col("up"))
        closure = checkpointed(closure.unionByName(closure.join(step, "a").select("n", F.col("up").alias("a"))).distinct())
        jump = checkpointed(jump.join(jump.select(F.col("n").alias("up"), F.col("up").alias("higher")), "up").select("n", F.col("higher").alias("up")))
        reach *= 2
    return closure.select(F.col("n").alias(key), F.col("a").alias("ancestor"))


def shared_value_edges(rows: DataFrame, key: str, values: list[Column]) -> DataFrame:
    """Star edges from each value's smallest key to the other keys with it: one row a key and value, not all pairs."""

    def star(kind: int, c: Column) -> DataFrame:
        v = rows.select(F.col(key).alias("b"), c.alias("v")).where("v is not null")
        return v.join(v.groupBy("v").agg(F.min("b").alias("a")), "v").where("a <> b").select("a", "b")

    return reduce(DataFrame.unionByName, [star(i, c) for i, c in enumerate(values)]).distinct()


def components(nodes: DataFrame, edges: DataFrame, key: str, checkpoint=None) -> DataFrame:
    """(key, component): the smallest key that edges (a, b) reach, for every node; keys are of any type that has an order.

    Each round takes the least label among neighbours and then jumps to the label's own label, so
    rounds grow with the logarithm of a component's diameter; they end when no label changes any more.
    Labels are written and read again each round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    keep = checkpoint or checkpointed
    both = keep(both)
    labels = keep(nodes.select(F.col(key).alias("n"), F.col(key).alias("l"), F.lit(True).alias("changed")))
    while not labels.where("changed").isEmpty():
        near = both.join(labels.select(F.col("n").alias("b"), "l"), "b").groupBy(F.col("a").alias("n")).agg(F.min("l").alias("m"))
        new = labels.join(near, "n", "left").select("n", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("l"))
        jumped = new.join(new.select(F.col("n").alias("l"), F.col("l").alias("ll")), "l", "left").select("n", "old", F.least("l", F.coalesce("ll", "l")).alias("l"))
        labels = keep(jumped.select("n", "l", (F.col("l") != F.col("old")).alias("changed")))
    return labels.select(F.col("n").alias(key), F.col("l").alias("component"))


def review_clusters(rows: DataFrame, key: str, signals: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(members, clusters) of rows that any of several signals links, directly or over others.

    members: (key, cluster), the smallest key naming a cluster of two rows or more; clusters:
    (cluster, size, <signal>: how many values two or more of its members share).  A null signal links
    nothing; keys are of any type that has an order.
    """
    known = checkpointed(rows.select(key, *[c.alias(n) for n, c in signals.items()]))
    edges = shared_value_edges(known, key, [F.col(n) for n in signals])
    found = components(known.select(key), edges, key)
    sizes = found.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("size")).where("size > 1")
    members = found.select(key, F.col("component").alias("cluster")).join(sizes.select("cluster"), "cluster", "left_semi")
    clusters = sizes
    for n in signals:
        shared = known.where(F.col(n).isNotNull()).join(members, key).groupBy("cluster", n).agg(F.count("*").alias("m")).where("m > 1")
        clusters = clusters.join(shared.groupBy("cluster").agg(F.count("*").alias(n)), "cluster", "left")
    return members.select(key, "cluster"), clusters.na.fill(0, list(signals))
