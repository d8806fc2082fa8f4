"""Entity matching: tiered names, printings, 64-bit hashes within a Hamming distance, identity groups, propagation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def tiered_lookup(rows: DataFrame, key: str, tiers: list[Column], index: DataFrame, name: str, unique: tuple[bool, ...] = ()) -> DataFrame:
    """(key, name, tier): the first tier of name keys that the index knows; a unique tier needs one index name for its key.

    Each tier is (key of a row, key of an index name) given as a pair of Columns in ``tiers``.
    """
    found = None
    left = rows
    for n, (row_key, index_key) in enumerate(tiers):
        names = index.select(F.col(name).alias("__name"), index_key.alias("__k")).where("__k is not null and __k <> ''").distinct()
        if n < len(unique) and unique[n]:
            names = names.groupBy("__k").agg(F.min("__name").alias("__name"), F.count("*").alias("__m")).where("__m = 1").drop("__m")
        hit = left.withColumn("__k", row_key).join(names, "__k").select(key, F.col("__name").alias(name), F.lit(n).alias("tier"))
        found = hit if found is None else found.unionByName(hit)
        left = left.join(hit.select(key), key, "left_anti")
    return found


def classify_matches(rows: DataFrame, candidates: DataFrame, key: str, scope: str) -> DataFrame:
    """(key, match, reason): candidates of a row's scope with its number, and its set if it read one.

    reason is no-text (no number read), no-match, ambiguous (more than one) or '' for a match.  Numbers
    compare without leading zeros.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "^0+(?=.)", "")
    r = rows.select(key, scope, F.nullif("set_code", F.lit("")).alias("rs"), F.nullif(bare(F.col("number")), F.lit("")).alias("rn"))
    c = candidates.select(scope, F.col("pk").alias("candidate"), F.col("set_code").alias("cs"), bare(F.col("number")).alias("rn"))
    hits = r.where("rn is not null").join(c, [scope, "rn"]).where("rs is null or rs = cs").groupBy(key).agg(F.count("*").alias("n"), F.min("candidate").alias("candidate"))
    n = F.coalesce("n", F.lit(0))
    reason = F.when(F.col("rn").isNull(), "no-text").when(n == 0, "no-match").when(n > 1, "ambiguous").otherwise("")
    return r.join(hits, key, "left").select(key, F.when(n == 1, F.col("candidate")).alias("match"), reason.alias("reason"))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ; right for negative numbers too."""
    return F.bit_count(a.bitwiseXOR(b))


def varying_bits(values: DataFrame) -> list[int]:
    """The places of the bits in which some values of column h differ; constant bits tell no values apart."""
    r = values.agg(F.bit_or("h").alias("some"), F.bit_and("h").alias("all")).first()
    return [k for k in range(64) if r["some"] is not None and (r["some"] ^ r["all"]) >> k & 1]


def bands(h: Column, distance: int, bits: list[int]) -> Column:
    """(pair of bands, their bits): of distance + 2 bands of the varying bits, values within the distance agree on two at least."""
    n = distance + 2
    cut = [bits[k * len(bits) // n : (k + 1) * len(bits) // n] for k in range(n)]
    whole = lambda b: h if b[-1] - b[0] == 63 else F.shiftrightunsigned(h, b[0]).bitwiseAND(F.lit((1 << b[-1] - b[0] + 1) - 1))
    part = [whole(b) if b else F.lit(0).cast("long") for b in cut]
    return F.array(*[F.struct(F.lit(i * n + j).alias("bands"), F.xxhash64(part[i], part[j]).alias("value")) for i in range(n) for j in range(i + 1, n)])


def near_values(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """(a, b, distance) of distinct hash values within a distance: they agree on two of distance + 2 bands.

    Values, not rows, are joined, so copies of one value cost nothing; a key of two bands has more bits
    than one of distance + 1 bands, so few values that are not near meet.  Bands hold bits that vary.
    """
    bits = varying_bits(left.select("h").unionByName(right.select("h")))
    a = left.where("h is not null").select(F.col("h").alias("a")).distinct().select("a", F.explode(bands(F.col("a"), distance, bits)).alias("k"))
    b = right.where("h is not null").select(F.col("h").alias("b")).distinct().select("b", F.explode(bands(F.col("b"), distance, bits)).alias("k"))
    d = hamming(F.col("a"), F.col("b"))
    return a.join(b, "k").where(d <= distance).select("a", "b", d.alias("distance")).distinct()


def near_sized(rows: DataFrame, key: str, h: str, distance: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, groups): (a, b, distance, n_a, n_b) of groups of equal values within a distance, and (h, r, n), their smallest key and size.

    The groups are written once; all else reads them, not the rows.  The smallest key stands for all
    rows of its value, so equal values cost a row each and no pairs.
    """
    known = rows.where(F.col(h).isNotNull()).groupBy(F.col(h).alias("h")).agg(F.min(key).alias("r"), F.count("*").alias("n"))
    groups = checkpointed(known)
    banded = groups.withColumn("k", F.explode(bands(F.col("h"), distance, varying_bits(groups))))
    d = hamming(F.col("x.h"), F.col("y.h"))
    met = banded.alias("x").join(banded.alias("y"), F.col("x.k") == F.col("y.k")).where((F.col("x.r") < F.col("y.r")) & (d <= distance))
    pairs = met.select(F.col("x.r").alias("a"), F.col("y.r").alias("b"), d.alias("distance"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).distinct()
    return pairs, groups


def near_groups(rows: DataFrame, key: str, h: str, distance: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (a, b, distance) of representatives a < b of values within a distance, and (key, representative)."""
    pairs, groups = near_sized(rows, key, h, distance)
    members = rows.where(F.col(h).isNotNull()).select(key, F.col(h).alias("h")).join(groups.select("h", F.col("r").alias("representative")), "h")
    return pairs.select("a", "b", "distance"), members.select(key, "representative")


def clear_winner(pairs: DataFrame, row: str, candidate: str, distance: str, threshold: int, margin: int) -> DataFrame:
    """(row, winner, best, reason): the nearest candidate within the threshold whose runner-up is farther by more than the margin."""
    two = pairs.withColumn("rn", F.row_number().over(Window.partitionBy(row).orderBy(distance, candidate))).where("rn <= 2")
    top = two.groupBy(row).agg(F.min(distance).alias("best"), F.max(distance).alias("second"), F.min_by(candidate, "rn").alias("c"), F.count("*").alias("n"))
    clear = (F.col("n") == 1) | (F.col("second") - F.col("best") > margin)
    reason = F.when(F.col("best") > threshold, "distance-miss").when(~clear, "margin-miss").otherwise("")
    return top.select(row, F.when(reason == "", F.col("c")).alias("winner"), "best", reason.alias("reason"))


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def identity_groups(rows: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """(key, n, least): the rows that share either non-empty value with a row, itself included, by counts of values: no pairs.

    Rows that share both are counted once: of one value, plus of the other, less of both together.
    """
    count, least = F.count("*"), F.min(key)
    of_one = rows.where(_filled(one)).groupBy(one).agg(count.alias("n1"), least.alias("l1"))
    of_two = rows.where(_filled(two)).groupBy(two).agg(count.alias("n2"), least.alias("l2"))
    of_both = rows.where(_filled(one) & _filled(two)).groupBy(one, two).agg(count.alias("n12"))
    known = rows.select(key, one, two).join(of_one, one, "left").join(of_two, two, "left").join(of_both, [one, two], "left")
    n = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0)) - F.coalesce("n12", F.lit(0))
    return known.select(key, F.greatest(n, F.lit(1)).alias("n"), F.least(key, "l1", "l2").alias("least"))


def widened(rows: DataFrame, key: str, values: list[str], chosen: DataFrame) -> DataFrame:
    """The chosen keys and all keys that share a non-empty value with one of them (one hop)."""
    mine = rows.join(chosen.select(key), key, "left_semi")
    parts = [rows.where(_filled(v)).join(mine.where(_filled(v)).select(v).distinct(), v, "left_semi").select(key) for v in values]
    return reduce(DataFrame.unionByName, [mine.select(key), *parts]).distinct()


def group_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the smallest key of their value's group, itself where the value is null or empty."""
    known = rows.where(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    least = known.groupBy(value).agg(F.min(key).alias("group"))
    return rows.join(least, value, "left").withColumn("group", F.coalesce("group", key))


def propagated(rows: DataFrame, key: str, h: str, value: str, voted: DataFrame | None = None) -> DataFrame:
    """(key, value, source): unresolved rows take the value of the smallest resolved key with their hash."""
    given = rows.where(F.col(h).isNotNull() & F.col(value).isNotNull()).groupBy(h).agg(F.min(F.struct(key, value)).alias("s"))
    out = rows.where(F.col(value).isNull()).select(key, h).join(given, h).select(key, F.col(f"s.{value}").alias(value), F.col(f"s.{key}").alias("source"))
    return out.join(voted, key, "left_anti") if voted is not None else out


def surviving(survivors: list[Column]) -> Column:
    """Intersection of candidate sets; null means no reading and narrows nothing, and all null gives null."""
    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_intersect(a, b))

    return reduce(both, survivors)


def surviving_counts(rows: DataFrame, key: str, scope: str, candidates: DataFrame, candidate: str, attributes: list[str]) -> DataFrame:
    """(key, n, match, n_read): how many candidates of a row's scope agree with all that was read, and the one if there is one.

    A null or empty reading narrows nothing; n is null where nothing was read.  Rows of a scope without
    candidates are left out.  Candidates are counted by each set of attributes, so a row meets one count,
    not the candidates of its scope.
    """
    read = [F.nullif(F.col(a), F.lit("")).alias(f"{a}_") for a in attributes]
    known = rows.join(candidates.select(scope).distinct(), scope, "left_semi").select(key, scope, *read)
    subsets = [[a for j, a in enumerate(attributes) if mask >> j & 1] for mask in range(1, 1 << len(attributes))]
    counts = reduce(
        DataFrame.unionByName,
        [
            candidates.where(reduce(Column.__and__, [F.col(a).isNotNull() for a in subset]))
            .groupBy(scope, *[(F.col(a) if a in subset else F.lit(None).cast("string")).alias(f"{a}_") for a in attributes])
            .agg(F.count("*").alias("n_"), F.min(candidate).alias("match_"))
            for subset in subsets
        ],
    )
    left, right = known.alias("l"), counts.alias("r")
    same = reduce(Column.__and__, [F.col(f"l.{a}_").eqNullSafe(F.col(f"r.{a}_")) for a in attributes], F.col(f"l.{scope}") == F.col(f"r.{scope}"))
    n_read = reduce(Column.__add__, [F.col(f"l.{a}_").isNotNull().cast("int") for a in attributes])
    n = F.when(n_read > 0, F.coalesce("n_", F.lit(0)))
    return left.join(right, same, "left").select(F.col(f"l.{key}").alias(key), n.alias("n"), F.when(n == 1, F.col("match_")).alias("match"), n_read.alias("n_read"))


def unique_prefix(rows: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, name): the exact name or, where none is, the only name that starts with the text.

    Names are counted by each of their beginnings, so texts of any length meet one row, not the names
    that share it.  A null or empty text has no name.
    """
    n = names.select(F.col(name).alias("n_")).where("n_ <> ''").distinct()
    begun = n.select("n_", F.explode(F.sequence(F.lit(1), F.length("n_"))).alias("to_")).select("n_", F.expr("substring(n_, 1, to_)").alias("p_"))
    known = begun.groupBy("p_").agg(F.count("*").alias("m_"), F.min("n_").alias("lo_"), F.max(F.col("n_") == F.col("p_")).alias("exact_"))
    found = rows.select(key, F.col(text).alias("p_")).join(known, "p_")
    return found.where("exact_ or m_ = 1").select(key, F.when(F.col("exact_"), F.col("p_")).otherwise(F.col("lo_")).alias(name))
