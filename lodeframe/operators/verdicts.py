"""Rule cascades: one row and its candidates give an outcome, or a named reason to abstain.

A calculator is a pair of Columns (outcome, confidence) and a skip reason over one joined row; rules
are ordered, and missing data never counts as evidence against anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fields import symbol_matches

# Confidences of the verdicts.
FULL_MATCH, NUMBER_MATCH, NO_MATCH, WEAKENED = 0.85, 0.75, 0.6, 0.65
TWO_READINGS, ONE_READING = 0.8, 0.7
YEARS_BEFORE_RELEASE = 2


def verdict(outcome: Column, confidence: Column, skip: Column) -> Column:
    return F.struct(outcome.alias("outcome"), confidence.cast("double").alias("confidence"), skip.alias("skip_reason"))


def join_key_verdict(match: Column, reason: Column, set_code: Column, known_sets: list[str] | None = None) -> Column:
    """A match by set and number, a weaker one by number alone, NO_MATCH, or a named skip."""
    has_set = F.coalesce(set_code, F.lit("")) != ""
    unknown = has_set & ~set_code.isin(known_sets) if known_sets is not None else F.lit(False)
    none = F.lit(None).cast("string")
    return (
        F.when(match.isNotNull(), verdict(match.cast("string"), F.when(has_set, FULL_MATCH).otherwise(NUMBER_MATCH), F.lit("")))
        .when((reason == "no-match") & unknown, verdict(none, F.lit(None), F.lit("unknown-set-code")))
        .when(reason == "no-match", verdict(F.lit("NO_MATCH"), F.lit(NO_MATCH), F.lit("")))
        .otherwise(verdict(none, F.lit(None), reason))
    )


def disagreement(a: Column, b: Column) -> Column:
    """Both are known and differ."""
    return F.coalesce((a != "") & (b != "") & (F.lower(a) != F.lower(b)), F.lit(False))


def agreement(confidence: Column, truncated: Column, year: Column, released: Column, artist: Column, known_artist: Column, border: Column, known_border: Column) -> Column:
    """(skip_reason, confidence): ordered vetoes, then what weakens a match."""
    skip = (
        F.when(F.coalesce(truncated, F.lit(False)), "truncated")
        .when(F.coalesce(released - year > YEARS_BEFORE_RELEASE, F.lit(False)), "year-before-release")
        .when(disagreement(artist, known_artist), "artist-mismatch")
        .otherwise("")
    )
    weaker = disagreement(border, known_border)
    return F.struct(skip.alias("skip_reason"), F.when(skip == "", F.when(weaker, F.least(confidence, F.lit(WEAKENED))).otherwise(confidence)).alias("confidence"))


def fallback_verdict(survivors: Column, two: Column) -> Column:
    """The only survivor of all readings; more readings make it surer."""
    n = F.when(survivors.isNotNull(), F.size(survivors))
    return counted_verdict(n, F.when(n == 1, F.element_at(survivors, 1)), F.when(two, 2).otherwise(1))


def counted_verdict(n: Column, match: Column, n_read: Column) -> Column:
    """The only survivor of n_read readings, from the number n of survivors (null: nothing was read)."""
    none = F.lit(None).cast("string")
    return (
        F.when(n.isNull(), verdict(none, F.lit(None), F.lit("no-reading")))
        .when(n == 1, verdict(match.cast("string"), F.when(n_read >= 2, TWO_READINGS).otherwise(ONE_READING), F.lit("")))
        .when(n == 0, verdict(none, F.lit(None), F.lit("no-survivor")))
        .otherwise(verdict(none, F.lit(None), F.lit("ambiguous")))
    )


def mapped(value: Column, table: dict[str, str], skip: str = "unmapped") -> Column:
    """The tag of a class by a small fixed table, or a named skip."""
    tag = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)
    return F.struct(tag.alias("tag"), F.when(tag.isNull(), skip).otherwise("").alias("skip_reason"))


def two_methods(a: Column, b: Column, most: float) -> Column:
    """The mean of two measurements, null where one is missing or they differ by more than ``most``."""
    return F.when(F.abs(a - b) <= most, (a + b) / 2)


def never_empty(narrowed: Column, original: Column) -> Column:
    """A filter that leaves nothing says nothing: the original stays."""
    return F.when(F.coalesce(F.size(narrowed), F.lit(0)) == 0, original).otherwise(narrowed)


def unresolved(rows: DataFrame, key: str, *channels: DataFrame) -> DataFrame:
    """Rows that no channel resolved."""
    for c in channels:
        rows = rows.join(c.select(key), key, "left_anti")
    return rows


def split_outcomes(rows: DataFrame, column: str = "v") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(votes, scan log, counts by skip reason) of one frame of verdicts."""
    votes = rows.where(F.col(f"{column}.outcome").isNotNull())
    log = rows.where(F.col(f"{column}.outcome").isNull())
    return votes, log, rows.groupBy(F.coalesce(F.col(f"{column}.skip_reason"), F.lit("")).alias("skip_reason")).agg(F.count("*").alias("n"))


def new_groups(proposed: DataFrame, stored: DataFrame, key: list[str], outcome: str) -> DataFrame:
    """Proposed rows of the groups whose whole set of outcomes differs from the stored one; equal groups are left out as a whole."""
    sets = lambda df, name: df.groupBy(*key).agg(F.array_sort(F.collect_set(outcome)).alias(name))
    changed = sets(proposed, "new").join(sets(stored, "old"), key, "left").where(~F.col("new").eqNullSafe(F.col("old"))).select(*key)
    return proposed.join(changed, key, "left_semi")


def compared(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, change): added, removed, changed or same."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    j = b.withColumn("hb", F.lit(True)).join(a.withColumn("ha", F.lit(True)), key, "full")
    change = F.when(F.col("hb").isNull(), "added").when(F.col("ha").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return j.select(key, "before", "after", change.alias("change"))


# Confidence of a tie that a symbol breaks, frames by class, and what a recovered frame mismatch casts.
SYMBOL_TIE = 0.75
FRAME_CLASSES = {"1993": "old", "1997": "old", "2003": "modern", "2015": "modern"}
RECOVERED_ARTIST, ALTERED_FRAME = 0.8, 0.7


def frame_mismatch(read: Column, known: Column) -> Column:
    """The frame that was read is not of the class of the known one; what is unknown or of no class never differs."""
    return disagreement(F.coalesce(read, F.lit("")), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in FRAME_CLASSES.items() for x in pair]), known), F.lit("")))


def ladder(confidence: Column, *, truncated: Column, border: Column, known_border: Column, frame: Column, known_frame: Column, year: Column, released: Column, line_artist: Column, artist: Column, known_artist: Column) -> Column:
    """(skip_reason, confidence) of a match, rung by rung.

    In turn a cut-off picture, a frame of another class, a year of rights long before the release, and
    another artist in the line that the match was read from withhold it.  What stays is weakened by
    another border, or by another artist where the picture's credit was read apart.
    """
    skip = (
        F.when(F.coalesce(truncated, F.lit(False)), "truncated-image")
        .when(frame_mismatch(frame, known_frame), "frame-mismatch")
        .when(F.coalesce(released - year > YEARS_BEFORE_RELEASE, F.lit(False)), "copyright-year-mismatch")
        .when(disagreement(line_artist, known_artist), "artist-mismatch")
        .otherwise("")
    )
    weaker = disagreement(border, known_border) | disagreement(artist, known_artist)
    return F.struct(skip.alias("skip_reason"), F.when(skip == "", F.when(weaker, F.least(confidence, F.lit(WEAKENED))).otherwise(confidence)).alias("confidence"))


def ties_broken(symbols: DataFrame, tied: DataFrame, glyphs: DataFrame, key: str) -> DataFrame:
    """(key, candidate): the smallest candidate of the one set whose glyph is near a row's symbol and clear of the other sets.

    symbols: (key, symbol); tied: (key, candidate, set_code); glyphs: (set_code, glyph).  Rows without
    a symbol, and ties that no glyph breaks, give none.
    """
    windows = symbols.where("symbol is not null").select(key, F.array("symbol").alias("hashes"))
    return symbol_matches(windows, tied, glyphs, key).groupBy(key).agg(F.min("candidate").alias("candidate"))


def recovered_frames(withheld: DataFrame, winners: DataFrame, printings: DataFrame, key: str) -> DataFrame:
    """(key, kind, outcome, confidence): what a second pass casts for rows withheld by their frame.

    withheld: (key); winners: (key, winner), the clear winner by hash where there is one; printings:
    (pk, artist).  A recovered row says its printing's artist, and that its frame was altered; rows
    without a clear winner say nothing.
    """
    found = withheld.select(key).distinct().join(winners.where("winner is not null"), key).join(printings.select(F.col("pk").alias("winner"), "artist"), "winner")
    cast = lambda kind, outcome, c: F.struct(F.lit(kind).alias("kind"), outcome.alias("outcome"), F.lit(c).alias("confidence"))
    return found.select(key, F.explode(F.array(cast("artist", F.col("artist"), RECOVERED_ARTIST), cast("tag", F.lit("altered-frame"), ALTERED_FRAME))).alias("v")).select(key, "v.*")


def eliminated(open_rows: DataFrame, uncovered: DataFrame, evidence: DataFrame, name: str, key: str) -> DataFrame:
    """(key, printing, reason): the only open row of a name and its only uncovered printing, if what was read of it agrees.

    open_rows: (name, key); uncovered: (name, printing, border, frame); evidence: (key, border, frame).
    A row without evidence abstains (``no-evidence``): counting says nothing about what a picture
    shows; another border or a frame of another class abstains too.  Then printing is null.
    """
    one_row = open_rows.groupBy(name).agg(F.min(key).alias(key), F.count("*").alias("n")).where("n = 1")
    one_printing = uncovered.groupBy(name).agg(F.min("printing").alias("printing"), F.min("border").alias("kb"), F.min("frame").alias("kf"), F.count("*").alias("m")).where("m = 1")
    both = one_row.join(one_printing, name).join(evidence.select(key, "border", "frame", F.lit(True).alias("seen")), key, "left")
    reason = F.when(F.col("seen").isNull(), "no-evidence").when(disagreement(F.col("border"), F.col("kb")), "border-mismatch").when(frame_mismatch(F.col("frame"), F.col("kf")), "frame-mismatch").otherwise("")
    return both.select(key, F.when(reason == "", F.col("printing")).alias("printing"), reason.alias("reason"))
