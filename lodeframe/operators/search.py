"""Catalogue search: filters, query terms, ranking, degradation, pages and samples.

Filters are Columns that fold into one predicate, so they reach the scan; a batch of queries is a
small DataFrame that is joined to the documents instead of one execution a query.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Term


@dataclass(frozen=True)
class Settings:
    """Structured filters; empty lists filter nothing."""

    sources: list[int] = field(default_factory=list)
    dpi: tuple[int, int] = (0, 1500)
    most_mb: float = 30.0
    types: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    include_tags: list[str] = field(default_factory=list)
    exclude_tags: list[str] = field(default_factory=list)
    set_code: str | None = None
    number: str | None = None


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def matches(s: Settings) -> Column:
    """Conjunction of the filters over columns source_pk, dpi, size, card_type, language, tags, set_code and number."""
    parts = [F.col("dpi").between(*s.dpi), F.col("size") <= F.lit(int(s.most_mb * 1_000_000))]
    if s.sources:
        parts.append(F.col("source_pk").isin(s.sources))
    if s.types:
        parts.append(F.col("card_type").isin(s.types))
    if s.languages:
        parts.append(F.lower("language").isin([x.lower() for x in s.languages]))
    if s.include_tags:
        parts.append(F.arrays_overlap("tags", _literals(s.include_tags)))
    if s.exclude_tags:
        parts.append(~F.arrays_overlap("tags", _literals(s.exclude_tags)))
    if s.set_code:
        parts.append(F.upper("set_code") == s.set_code.upper())
    if s.number:
        parts.append(F.col("number") == s.number)
    return reduce(and_, parts)


def term_filter(term: Term, columns: dict[str, str] | None = None) -> Column:
    """One query term as a predicate: artist by words, set in upper case, border, frame and lang in lower case, tag as it is.

    A blank value filters nothing; a negated term also keeps rows without a value.
    """
    name = (columns or {}).get(term.operator, {"set": "set_code", "lang": "language", "tag": "tags"}.get(term.operator, term.operator))
    value = term.value.strip()
    if not value:
        return F.lit(True)
    c = F.col(name)
    if term.operator == "artist":
        hit = reduce(and_, [F.lower(c).contains(w) for w in value.lower().split()])
    elif term.operator == "set":
        hit = F.upper(c) == value.upper()
    elif term.operator == "tag":
        hit = F.array_contains(c, value)
    else:
        hit = F.lower(c) == value.lower()
    return ~F.coalesce(hit, F.lit(False)) if term.negated else F.coalesce(hit, F.lit(False))


def terms_filter(terms: list[Term], columns: dict[str, str] | None = None) -> Column:
    return reduce(and_, [term_filter(t, columns) for t in terms], F.lit(True))


def unknown_passes(known: Column, condition: Column) -> Column:
    """Rows without a resolved value are never excluded."""
    return ~known | F.coalesce(condition, F.lit(False))


def tags_related(tags: Column, wanted: list[str], unwanted: list[str]) -> Column:
    """Tags contain all of the wanted or are contained in them (so untagged rows pass), and hold none of the unwanted."""
    w = _literals(wanted)
    inner = (F.size(F.array_except(w, tags)) == 0) | (F.size(F.array_except(tags, w)) == 0) if wanted else F.lit(True)
    return inner & ~F.coalesce(F.arrays_overlap(tags, _literals(unwanted)), F.lit(False)) if unwanted else inner


def all_words(c: Column, text: str) -> Column:
    """Every word of a normalised query is part of the name; an empty query matches nothing."""
    words = text.split()
    return reduce(and_, [F.lower(c).contains(w) for w in words]) if words else F.lit(False)


def match_tier(set_code: Column, number: Column, want_set: str | None, want_number: str | None) -> Column:
    """0 for set and number, 1 for the set alone, 2 otherwise."""
    if not want_set:
        return F.lit(2)
    same = F.coalesce(F.upper(set_code) == want_set.upper(), F.lit(False))
    return F.when(same & F.coalesce(number == F.lit(want_number), F.lit(False)), 0).when(same, 1).otherwise(2)


def ranked(rows: DataFrame, *order: Column, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Row numbers from 1; within ``by`` where it is given.  Without it all rows meet in one task: use it on pages and top-k."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w))


def degraded(exact: DataFrame, relaxed: DataFrame, key: str) -> DataFrame:
    """By key the exact hits, or the relaxed ones (degraded = true) where there are none."""
    rest = relaxed.join(exact.select(key).distinct(), key, "left_anti")
    return exact.withColumn("degraded", F.lit(False)).unionByName(rest.withColumn("degraded", F.lit(True)))


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def autocomplete(rows: DataFrame, name: str, text: str, n: int = 10) -> DataFrame:
    """Names that start with the text, topped up by those that contain it."""
    low = text.lower()
    hits = rows.select(name).distinct().where(F.lower(name).contains(low))
    return hits.withColumn("tier", F.when(F.lower(name).startswith(low), 0).otherwise(1)).orderBy("tier", name).limit(n)


def after_key(rows: DataFrame, key: str, last: int, n: int) -> DataFrame:
    """Keyset pagination."""
    return rows.where(F.col(key) > last).orderBy(key).limit(n)


def stratum(rows: DataFrame, key: str, lo: int, hi: int, strata: int) -> DataFrame:
    """rows with the number of their key's part among ``strata`` equal key ranges."""
    part = F.least(F.floor((F.col(key) - lo) * strata / F.lit(max(hi - lo + 1, 1))), F.lit(strata - 1)).cast("int")
    return rows.withColumn("stratum", part)


def strata_sample(rows: DataFrame, key: str, lo: int, hi: int, strata: int, n: int, seed: int = 0) -> DataFrame:
    """Up to ceil(n / strata) * 2 rows from each of ``strata`` equal key ranges, by a seeded hash."""
    w = Window.partitionBy("stratum").orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return stratum(rows, key, lo, hi, strata).withColumn("r", F.row_number().over(w)).where(F.col("r") <= -(-n // strata) * 2)


def keyed_sample(rows: DataFrame, key: str, n: int, order: Column | None = None) -> DataFrame:
    """The same n keys for the same n, sorted."""
    return rows.orderBy(order if order is not None else F.xxhash64(F.col(key), F.lit(n)), key).limit(n).orderBy(key)


def rotated(rows: DataFrame, position: str, n: int, offset: int, window: int, score: str) -> DataFrame:
    """Queue order from an offset: best score first inside the first window, then by rotation."""
    turned = F.pmod(F.col(position) - offset, F.lit(n))
    return rows.withColumn("turn", turned).withColumn("key", F.when(turned < window, F.struct(F.lit(0).alias("w"), (-F.col(score)).cast("double").alias("s"), turned.alias("t"))).otherwise(F.struct(F.lit(1).alias("w"), F.lit(0.0).alias("s"), turned.alias("t"))))


def interleaved(rows: DataFrame, group: str, order: list[Column], position: Column) -> DataFrame:
    """Round robin: the first row of every group in the order of the groups' first positions, then the second rows ..."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    first = F.min(position).over(Window.partitionBy(group))
    return rows.withColumn("nth", nth).withColumn("first_position", first)


def newest(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The n first rows of each group in an order; ranking stops at n in each task before rows move."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= n)


#: Rows of all groups that one stretch of the order key covers, about, and the most stretches.
STRETCH, STRETCHES = 1 << 16, 4096


def stretched(rows: DataFrame, order: str, stretch: int = STRETCH) -> DataFrame:
    """rows with ``stretch_``: which of the stretches of about equal rows an integer key is in, cut at quantiles of all keys.

    Sparse keys (hashes, say) are cut as dense ones are.  A stretch holds whole keys in their order.
    """
    parts = min(STRETCHES, -(-rows.count() // stretch))
    if parts < 2:
        return rows.withColumn("stretch_", F.lit(0.0))
    cuts = rows.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [k / parts for k in range(1, parts)], 1 / (4 * parts))  # a number a stretch
    keyed = rows.withColumn("order_", F.col(order).cast("double"))
    return Bucketizer(splits=[float("-inf"), *sorted(set(cuts)), float("inf")], inputCol="order_", outputCol="stretch_", handleInvalid="keep").transform(keyed).drop("order_")


def running_sum(rows: DataFrame, group: list[str], order: str, value: Column, name: str, stretch: int = STRETCH) -> DataFrame:
    """rows with the sum of ``value`` over their group up to and with themselves, in the order of a unique integer key.

    A group is summed by stretches of the key and within them, so one that holds most of the table is no
    single task's: only its stretches' sums, a row each, meet.
    """
    cut = stretched(rows, order, stretch).withColumn("value_", value)
    within = F.sum("value_").over(Window.partitionBy(*group, "stretch_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    sums = cut.groupBy(*group, "stretch_").agg(F.sum("value_").alias("sum_"))
    before = F.sum("sum_").over(Window.partitionBy(*group).orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(g).alias(f"{g}_") for g in group], F.col("stretch_").alias("s_"), F.coalesce(before, F.lit(0)).alias("before_"))
    same = F.col("stretch_") == F.col("s_")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    return cut.join(sums, same).withColumn(name, (within + F.col("before_"))).select(*rows.columns, name)


def split_bins(rows: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    """Bins of at most ``size`` rows within each group, in the order of a unique integer key."""
    numbered = running_sum(rows, group, order, F.lit(1).cast("long"), "rn_")
    return numbered.withColumn("bin", F.floor((F.col("rn_") - 1) / size)).withColumn("slot", (F.col("rn_") - 1) % size).drop("rn_")


def rolling_sum(rows: DataFrame, group: list[str], order: str, value: Column, n: int, name: str) -> DataFrame:
    """rows with the sum of ``value`` over the last n rows of their group, themselves included.

    It is the running sum less that of n rows before, found by its number.
    """
    numbered = running_sum(running_sum(rows, group, order, F.lit(1).cast("long"), "rn_"), group, order, value, "sum_")
    earlier = numbered.select(*[F.col(g).alias(f"{g}_") for g in group], (F.col("rn_") + n).alias("at_"), F.col("sum_").alias("less_"))
    same = F.col("rn_") == F.col("at_")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    return numbered.join(earlier, same, "left").withColumn(name, F.col("sum_") - F.coalesce("less_", F.lit(0))).select(*rows.columns, name)


#: Ways to sort what a search found: column, descending; ties go by name, then by key.
SORTS = {
    "nameAscending": ("name", False),
    "nameDescending": ("name", True),
    "dateCreatedAscending": ("date_created", False),
    "dateCreatedDescending": ("date_created", True),
    "dateModifiedAscending": ("date_modified", False),
    "dateModifiedDescending": ("date_modified", True),
}
#: Fixed value: the most rows of a page.
PAGE = 100


def explored(hits: DataFrame, sort_by: str, first: int, size: int, columns: dict[str, str], key: str) -> DataFrame:
    """(key, place, total): a page of the hits in one of the ways of ``SORTS``, behind the first rows, with how many hits there are.

    columns: which columns are ``name``, ``date_created`` and ``date_modified``.  Nulls come last
    ascending and descending.  A page beyond the last hit is empty.
    """
    if sort_by not in SORTS:
        raise ValueError(f"sort by one of {', '.join(SORTS)}")
    if first < 0 or not 0 < size <= PAGE:
        raise ValueError(f"a page starts at 0 or later and has 1 to {PAGE} rows")
    by, descending = SORTS[sort_by]
    c = F.col(columns[by])
    order = [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(columns["name"]).asc_nulls_last(), F.col(key)]
    top = hits.select(key, *columns.values()).orderBy(*order).limit(first + size)  # a page, bounded by where it ends
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > first)
    return placed.select(key, "place").crossJoin(hits.agg(F.count("*").alias("total")))
