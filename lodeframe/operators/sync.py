"""Snapshot synchronisation, idempotent replacement, archives, backfills and row transforms."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the listing transform.
MOST_BYTES = 30_000_000
DPI_BY_HEIGHT = 300 / 1110


def diffed(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str], newer: str | None = None) -> DataFrame:
    """Incoming and deleted rows with ``op``: created, updated, unchanged or deleted, in one full outer join.

    A row is updated if a field differs (null equals null), or its ``newer`` stamp is later.
    """
    old = stored.select(key, *[F.col(f).alias(f"__o_{f}") for f in {*fields, *([newer] if newer else [])}], F.lit(True).alias("__old"))
    both = incoming.withColumn("__new", F.lit(True)).join(old, key, "full")
    differs = reduce(or_, [~F.col(f).eqNullSafe(F.col(f"__o_{f}")) for f in fields], F.lit(False))
    if newer:
        differs = differs | F.coalesce(F.col(newer) > F.col(f"__o_{newer}"), F.lit(False))
    op = F.when(F.col("__new").isNull(), "deleted").when(F.col("__old").isNull(), "created").when(differs, "updated").otherwise("unchanged")
    return both.withColumn("op", op).select(*incoming.columns, "op")


def counts_by_op(rows: DataFrame) -> DataFrame:
    return rows.groupBy("op").agg(F.count("*").alias("n"))


def upserted(stored: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """The snapshot with changed rows in place of those of their keys."""
    return stored.join(changed.select(*key), key, "left_anti").unionByName(changed)


def inserted_only(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key is not stored; of rows that repeat a key one is taken."""
    return rows.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def replaced(stored: DataFrame, new: DataFrame, key: list[str], family: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(table, archive): for the targeted keys all old rows of a calculator's family give way to the new ones and are archived with the run."""
    same = T.agent_key(F.col("agent")) == family
    targets = new.select(*key).distinct()
    hit = stored.where(same).join(targets, key, "left_semi")
    rest = stored.where(~F.coalesce(same, F.lit(False))).unionByName(stored.where(same).join(targets, key, "left_anti"))
    return rest.unionByName(new), hit.withColumn("superseded_by_run_id", F.lit(run_id))


def retracted(stored: DataFrame, condition: Column) -> DataFrame:
    return stored.where(~F.coalesce(condition, F.lit(False)))


def backfilled(rows: DataFrame, values: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fills nulls from values by key and never overwrites."""
    v = values.select(key, *[F.col(f).alias(f"__v_{f}") for f in fields])
    out = rows.join(v, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f), F.col(f"__v_{f}")))
    return out.select(*rows.columns)


def warmed(cached: DataFrame, live: DataFrame, now: DataFrame, key: str, value: str, hours: int, forced: Column | None = None) -> DataFrame:
    """(key, value, generated_at): cached aggregates, or live ones stamped with now where the cache has none, is too old, or a refresh is forced.

    cached: (key, value, generated_at); live: (key, value); now: one row.  Keys that live has no more leave the cache.
    """
    old = cached.select(key, F.col(value).alias("old_"), "generated_at")
    both = live.join(old, key, "left").crossJoin(F.broadcast(now.select(F.col(now.columns[0]).alias("now_"))))  # one row
    good = F.coalesce(F.col("generated_at") > F.col("now_") - F.make_dt_interval(hours=F.lit(hours)), F.lit(False))
    good = good & ~F.coalesce(forced, F.lit(False)) if forced is not None else good
    return both.select(key, F.when(good, F.col("old_")).otherwise(F.col(value)).alias(value), F.when(good, F.col("generated_at")).otherwise(F.col("now_")).alias("generated_at"))


def last_vote(votes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins: one row for each key."""
    rest = [c for c in votes.columns if c not in key]
    return votes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def listed_row(size: Column, height: Column, name: Column, folder: Column, default_folder: str = "Cardbacks") -> dict[str, Column]:
    """dpi, priority and card_type of a listing's row, and why it is refused (null if it is not)."""
    low = F.lower(folder)
    tagged = (name.contains("(") & name.contains(")")) | (F.size(T.tag_parts(name)) > 0)
    return {
        "dpi": (10 * F.bround(height * DPI_BY_HEIGHT / 10, 0)).cast("long"),
        "priority": F.when(tagged, 1).otherwise(2) + F.when(folder == default_folder, 5).otherwise(0) + F.when(low.contains("basic"), 5).otherwise(0),
        "card_type": F.when(low.contains("token"), "TOKEN").when(low.contains("cardbacks") | low.contains("card backs"), "CARDBACK").otherwise("CARD"),
        "refused": F.when(size > MOST_BYTES, "too-large").when(F.coalesce(T.extension(name), F.lit("")) == "", "no-extension"),
    }


def quarantined(rows: DataFrame, reason: str = "refused") -> tuple[DataFrame, DataFrame]:
    """(good, bad): a bad row is set aside with its reason, and the batch survives."""
    return rows.where(F.col(reason).isNull()).drop(reason), rows.where(F.col(reason).isNotNull())


def enriched(rows: DataFrame, dim: DataFrame, key: str, surrogate: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the surrogate key and the number of rows of their group, unmatched rows)."""
    d = dim.select(key, surrogate)
    found = rows.join(d, key)
    sizes = found.groupBy(group).agg(F.count("*").alias("group_rows"))
    return found.join(sizes, group), rows.join(d.select(key), key, "left_anti")


def merged_lists(public: DataFrame, private: DataFrame, key: Column, order: str) -> DataFrame:
    """Two lists by normalised key, the private row winning; ordinal is the position in the merged list (a small table)."""
    from pyspark.sql import Window

    a, b = private.withColumn("__k", key).withColumn("__p", F.lit(1)), public.withColumn("__k", key).withColumn("__p", F.lit(0))
    kept = a.unionByName(b.join(a.select("__k"), "__k", "left_anti").select(*a.columns))
    return kept.withColumn("ordinal", F.row_number().over(Window.orderBy("__p", order)) - 1).drop("__k", "__p")
