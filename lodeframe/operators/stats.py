"""Statistics panels: contributions, buckets, funnels, gates and quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contributions(sources: DataFrame, rows: DataFrame, source_key: str, row_key: str, dpi: str, size: str) -> DataFrame:
    """By source: rows, total dpi and bytes, and formatted mean dpi ("0" without rows); sources without rows survive."""
    sums = rows.groupBy(F.col(row_key).alias(source_key)).agg(F.count("*").alias("qty"), F.sum(dpi).cast("long").alias("total_dpi"), F.sum(size).cast("long").alias("total_size"))
    out = sources.join(sums, source_key, "left").fillna(0, ["qty", "total_dpi", "total_size"])
    mean = F.when(F.col("qty") > 0, F.format_number(F.floor(F.col("total_dpi") / F.col("qty")), 0)).otherwise("0")
    return out.withColumn("avg_dpi", mean)


def truncated_mean(total: Column, n: Column) -> Column:
    """int(total / n), 0 where there is nothing."""
    return F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0))


def weekly(events: DataFrame, ts: str, category: str, since: Column) -> DataFrame:
    """Counts by Monday week and category from ``since`` on; only weeks with rows."""
    return events.where(F.col(ts) >= since).groupBy(F.date_trunc("week", ts).alias("week"), category).agg(F.count("*").alias("n"))


def breakdown(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by each prefix of the keys in one pass: the last keys are null in the coarser rows, level tells them apart."""
    sets = [list(keys[:i]) for i in range(1, len(keys) + 1)]
    return rows.groupingSets(sets, *keys).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def history(runs: DataFrame, started: str, finished: str, n: int, *ties: str) -> DataFrame:
    """The newest runs with their duration in seconds, null while unfinished."""
    took = F.unix_timestamp(finished) - F.unix_timestamp(started)
    return runs.withColumn("seconds", took).orderBy(F.desc(started), *ties).limit(n)


def participation(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct entities in any and in all of several tables, in one pass over their union."""
    every = reduce(DataFrame.unionByName, [df.select(F.col(c).alias("e"), F.lit(1 << i).alias("bit")) for i, (df, c) in enumerate(tables)])
    seen = every.where("e is not null").groupBy("e").agg(F.bit_or("bit").alias("mask"))
    return seen.agg(F.count("*").alias("n_any"), F.count_if(F.col("mask") == (1 << len(tables)) - 1).alias("n_all"))


def duplicate_groups(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Groups of equal non-empty keys: how many, their rows, and the bytes that copies beyond the largest row take."""
    groups = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.max(size).alias("top")).where("n > 1")
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("total") - F.col("top")), F.lit(0)).alias("spare_bytes"))


def conditional_counts(rows: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def ratio(rows: DataFrame, key: str, condition: Column, name: str = "ratio") -> DataFrame:
    """Share of rows that satisfy the condition by key; 0.0 where there are none."""
    return rows.groupBy(key).agg(F.coalesce(F.count_if(condition) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias(name))


def distinct_where(rows: DataFrame, entity: str, conditions: dict[str, Column]) -> DataFrame:
    """Distinct entities under each condition, counted from one flag row an entity."""
    flags = rows.groupBy(entity).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])
    return flags.agg(*[F.count_if(F.col(n)).alias(n) for n in conditions])


def filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_filled): rows that hold neither null nor an empty text in each column."""
    counts = rows.agg(*[F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in columns])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("field", "n_filled"))


def gate(total: Column, good: Column, least: float) -> Column:
    """PASS, FAIL, or INSUFFICIENT where nothing was counted."""
    return F.when(total == 0, "INSUFFICIENT").when(good / F.nullif(total, F.lit(0)) >= least, "PASS").otherwise("FAIL")


def version_stamp(rows: DataFrame, key: str, nullable: str, number: str) -> DataFrame:
    """One row that changes when a table does: largest key, rows, non-null values, and a sum."""
    return rows.agg(F.max(key).alias("max_key"), F.count("*").alias("n"), F.count(nullable).alias("n_set"), F.sum(number).cast("long").alias("total"))


def hard_names(scans: DataFrame, voted: DataFrame, name: str, entity: str, least: int) -> DataFrame:
    """Names with ``least`` distinct scanned entities or more that were never voted on."""
    return scans.groupBy(name).agg(F.countDistinct(entity).alias("n")).where(F.col("n") >= least).join(voted.select(name).distinct(), name, "left_anti")


def least_by_key(rows: DataFrame, key: Column, value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(F.lower(key).alias("key")).agg(F.min(value).alias("least"))


def divergence(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Clusters of equal keys (two rows or more) whose resolved values differ."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(value).alias("n_values"), F.array_sort(F.collect_set(value)).alias("seen")).where("n >= 2 and n_values > 1")
