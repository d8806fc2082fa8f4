"""What an uploaded file's name says: printing, artist, set hint and tags in brackets, and aliases learnt from near spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import sequence_ratio, sequence_similarity
from ..session import checkpointed
from .best import best_entries, tiers
from .clustering import ancestors

# A near spelling becomes an alias from the first ratio on, and a suggestion from the second.
ALIAS, SUGGESTION = 0.92, 0.6
# Least ratio of a reading, and the most entries that a cut-off reading may begin.
READING, COMPATIBLE, CUT_LETTERS = 0.85, 6, 6
#: What the best entry must lead the next by: a recognised text's, and a line's.
MARGIN, LEAD = 0.06, 0.05


def raw_tags(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, raw) for each distinct comma-separated text in the brackets of a name."""
    return names.select(key, F.explode(T.tag_parts(F.col(name))).alias("raw")).where("raw <> ''").distinct()


def only_match(tags: DataFrame, key: str, known: DataFrame, pk: str) -> DataFrame:
    """(key, raw, pk): the known text that a name holds, if it holds exactly one.  known: (raw, pk)."""
    hits = tags.join(known, "raw").groupBy(key).agg(F.count_distinct("raw").alias("m"), F.min("raw").alias("raw"), F.min(pk).alias(pk))
    return hits.where("m = 1").drop("m")


def known_tags(tags: DataFrame) -> DataFrame:
    """(low, pk): each lower-cased name and alias of tags (pk, name, aliases); a name goes before an alias, then the smaller pk."""
    texts = tags.select("pk", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.col("name").alias("text"))), F.transform("aliases", lambda a: F.struct(F.lit(1).alias("kind"), a.alias("text"))))).alias("t"))
    return texts.groupBy(F.lower("t.text").alias("low")).agg(F.min(F.struct("t.kind", "pk")).alias("m")).select("low", F.col("m.pk").alias("pk"))


def suggested(raws: DataFrame, tags: DataFrame, stored: DataFrame) -> DataFrame:
    """The table of suggestions (raw, tag_pk, ratio, occurrences, status) after rows of raws (raw), each an occurrence.

    A text that is no tag's name or alias takes the nearest tag (ties to the smaller pk): from
    ``ALIAS`` on it is AUTO_ACCEPTED, from ``SUGGESTION`` on PENDING.  Stored rows gain the new
    occurrences; PENDING may become AUTO_ACCEPTED, never the reverse; REJECTED stays as it is.
    Each text looks for its nearest alone (``best.best_entries``); tags whose texts read alike are one
    candidate, that of the smallest pk.
    """
    new = raws.groupBy("raw").agg(F.count("*").alias("seen")).join(known_tags(tags).select("low"), F.lower("raw") == F.col("low"), "left_anti")
    new = new.join(stored.where("status = 'REJECTED'").select("raw"), "raw", "left_anti").withColumn("q", T.searchable(F.col("raw"))).where("q <> ''")
    texts = tags.select("pk", F.explode(F.concat(F.array("name"), "aliases")).alias("t")).groupBy(T.searchable(F.col("t")).alias("c")).agg(F.min("pk").alias("pk"))
    new, texts, nearest = checkpointed(new), checkpointed(texts), None
    left = new.select("q").distinct()
    for t in tiers(SUGGESTION):
        found = best_entries(left, "q", texts, "c", t, 1, "pk")
        nearest = found if nearest is None else nearest.unionByName(found)
        left = checkpointed(left.join(found, "q", "left_anti"))
    best = new.join(nearest.join(texts, "c"), "q").select("raw", "seen", "ratio", F.col("pk").alias("tag_pk"))
    fresh = best.withColumn("status", F.when(F.col("ratio") >= ALIAS, "AUTO_ACCEPTED").otherwise("PENDING"))
    s, f = stored.alias("s"), fresh.alias("f")
    both = s.join(f, F.col("s.raw") == F.col("f.raw"), "full")
    status = F.when(F.col("f.raw").isNull(), F.col("s.status")).when((F.col("s.status") == "AUTO_ACCEPTED") | F.col("s.status").isNull(), F.coalesce("s.status", "f.status")).otherwise(F.col("f.status"))
    return both.select(
        F.coalesce("s.raw", "f.raw").alias("raw"),
        F.coalesce("f.tag_pk", "s.tag_pk").alias("tag_pk"),
        F.coalesce("f.ratio", "s.ratio").alias("ratio"),
        (F.coalesce("s.occurrences", F.lit(0)) + F.coalesce("f.seen", F.lit(0))).alias("occurrences"),
        status.alias("status"),
    )


def extracted(names: DataFrame, key: str, name: str, printings: DataFrame, artists: DataFrame, codes: DataFrame, tags: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, bare, card_pk, artist_pk, hint, tags) of names such as ``Name [SET 12, Foil] (Artist)``.

    In turn: the one printing whose ``SET number`` stands in brackets (or whose set does, with the
    number in braces); without one, the one artist; without a printing, a set code alone as a hint (the
    smallest of several); then tags by name, alias or accepted near spelling (``aliases``: raw, tag_pk),
    with all tags above them.  What was understood leaves the name.  printings: (pk, set_code, number);
    artists: (pk, name); codes: (code); tags: (pk, name, aliases, parent_pk).
    """
    base = names.select(key, T.without_brace_number(F.col(name)).alias("bare"), T.brace_number(F.col(name)).alias("number"))
    raws = raw_tags(names, key, name)
    labelled = raws.join(base.select(key, "number"), key).select(key, F.concat_ws(" ", "raw", "number").alias("raw"))
    cards = only_match(labelled, key, printings.groupBy(F.concat(F.upper("set_code"), F.lit(" "), "number").alias("raw")).agg(F.max("pk").alias("card_pk")), "card_pk")
    left = raws.join(cards.select(key), key, "left_anti")
    artist = only_match(left, key, artists.groupBy(F.col("name").alias("raw")).agg(F.max("pk").alias("artist_pk")), "artist_pk")
    hints = left.join(codes.select(F.lower("code").alias("hint")).distinct(), F.lower("raw") == F.col("hint")).groupBy(key).agg(F.min_by("raw", F.struct("hint", "raw")).alias("raw"), F.min("hint").alias("hint"))
    known = known_tags(tags)
    if aliases is not None:
        extra = aliases.groupBy(F.lower("raw").alias("low")).agg(F.min("tag_pk").alias("pk"))
        known = known.unionByName(extra.join(known.select("low"), "low", "left_anti"))
    own = raws.join(known.select("low", F.col("pk").alias("tag_")), F.lower("raw") == F.col("low")).select(key, "raw", "tag_")
    above = ancestors(tags, "pk", "parent_pk").join(tags.select(F.col("pk").alias("ancestor"), F.col("name").alias("tag")), "ancestor").select(F.col("pk").alias("tag_"), "tag")
    implied = own.join(above, "tag_").groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    gone = cards.select(key, "raw").unionByName(artist.select(key, "raw")).unionByName(hints.select(key, "raw")).unionByName(own.select(key, "raw"))
    gone = gone.groupBy(key).agg(F.sort_array(F.collect_set("raw"), asc=False).alias("gone"))  # longer texts go before their beginnings
    out = base.join(cards.select(key, "card_pk"), key, "left").join(artist.select(key, "artist_pk"), key, "left").join(hints.select(key, "hint"), key, "left").join(implied, key, "left").join(gone, key, "left")
    bare = F.when(F.col("gone").isNotNull(), F.aggregate("gone", F.col("bare"), T.without_tag)).otherwise(T.collapse_spaces(F.col("bare")))
    return out.select(key, bare.alias("bare"), "card_pk", "artist_pk", "hint", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def with_back_faces(lines: DataFrame, pairs: DataFrame, front: str = "front", back: str = "back") -> DataFrame:
    """Deck lines with the back of a double-faced name where the line gives none; pairs: (front, back), compared as searchable texts."""
    known = pairs.groupBy(T.searchable(F.col("front")).alias("k_")).agg(F.min("back").alias("b_"))
    return lines.withColumn("k_", T.searchable(F.col(front))).join(known, "k_", "left").withColumn(back, F.coalesce(back, "b_")).drop("k_", "b_")


def recovered(lines: DataFrame, key: str, text: str, lexicon: DataFrame, entry: str, allowed: DataFrame | None = None) -> DataFrame:
    """(key, entry, ratio): the entry that windows of 1 to 4 words of a line read best, if it leads.

    A window of a line with entries of its own (``allowed``: key, entry) meets these alone; the others look
    for their best two entries, first the near ones and then, where the line is not settled, down to ``READING``.  A
    window of ``CUT_LETTERS`` letters or more that some entries begin with is a cut-off reading of them, if
    they are ``COMPATIBLE`` at most.  The best must lead the next entry by ``LEAD``.
    """
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    words = F.filter(F.split(F.col(text), r"[^\p{L}'.-]+"), lambda w: w != "")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.transform(F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(words, k + 1, n), ""))))
    windows = checkpointed(lines.select(key, F.explode(grams).alias("w")).select(key, letters(F.col("w")).alias("w")).where(F.length("w") >= 3).distinct())
    names = checkpointed(lexicon.select(F.col(entry).alias("entry"), letters(F.col(entry)).alias("e")).where(F.length("e") >= 3).distinct())
    begun = names.withColumn("p", F.explode(F.sequence(F.lit(CUT_LETTERS), F.length("e") - 1))).where(F.length("e") > CUT_LETTERS).select("entry", F.expr("substring(e, 1, p)").alias("w"))
    few = begun.groupBy("w").agg(F.count_distinct("entry").alias("m")).where(F.col("m") <= COMPATIBLE).select("w")
    cut = windows.join(begun.join(few, "w", "left_semi"), "w").select(key, "entry", F.lit(READING).alias("ratio"))
    read, free = None, windows
    if allowed is not None:
        own = checkpointed(allowed.select(key, F.col(entry).alias("entry")).distinct())
        n, m = F.length("w"), F.length("e")
        met = windows.join(own.join(names, "entry"), key).where(F.least(n, m) * (2 - READING) + 1e-9 >= F.greatest(n, m) * READING)
        ratios = checkpointed(met.select("w", "e").distinct().withColumn("ratio", sequence_similarity("w", "e")).where(F.col("ratio") >= READING))
        read = met.join(ratios, ["w", "e"]).select(key, "entry", "ratio").unionByName(cut.join(own, [key, "entry"], "left_semi"))
        lines_with = own.select(key).distinct()
        free, cut = checkpointed(windows.join(lines_with, key, "left_anti")), cut.join(lines_with, key, "left_anti")
    # Entries that read alike have one ratio: two of them are enough for a tie.
    alike = names.groupBy("e").agg(F.array(F.max("entry"), F.min("entry")).alias("entries"))
    seen, left = checkpointed(cut), free
    for t in tiers(READING):
        found = best_entries(left, "w", names, "e", t, 2, score=sequence_ratio)
        whole = left.join(found, "w").join(alike, "e").select(key, F.explode(F.array_distinct("entries")).alias("entry"), "ratio")
        seen = checkpointed(seen.unionByName(whole).groupBy(key, "entry").agg(F.max("ratio").alias("ratio")))
        first = F.slice(F.array_sort(F.collect_list(-F.col("ratio"))), 1, 2)
        # What was not seen is below t: it neither wins nor comes near such a best.
        settled = seen.groupBy(key).agg(first.alias("r")).where((-F.col("r")[0] - LEAD >= t) | (-F.coalesce(F.get("r", F.lit(1)), F.lit(0.0)) >= t))
        left = checkpointed(left.join(settled, key, "left_anti"))
    read = seen if read is None else read.groupBy(key, "entry").agg(F.max("ratio").alias("ratio")).unionByName(seen)
    top = read.groupBy(key).agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("ratio", "entry")))), 1, 2).alias("r"))
    second = F.try_element_at("r", F.lit(2))["ratio"]
    return top.where(second.isNull() | (F.col("r")[0]["ratio"] - second >= LEAD)).select(key, F.col("r")[0]["entry"].alias("entry"), F.col("r")[0]["ratio"].alias("ratio"))


def recognised(reads: DataFrame, text: str, lexicon: DataFrame, entry: str, floor: float = READING, margin: float = MARGIN) -> DataFrame:
    """(text, entry, ratio) of the distinct texts whose best entry reaches ``floor`` and leads the next by ``margin``.

    Each text looks for its best two, first near ones alone; one that is settled (no unseen entry can
    come within the margin, or the next is seen already) looks no further.
    """
    left = checkpointed(reads.select(text).where(F.col(text).isNotNull()).distinct())
    lexicon = checkpointed(lexicon.select(entry).distinct())
    seen = None
    for t in tiers(floor - margin):
        found = best_entries(left, text, lexicon, entry, t).groupBy(text).agg(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("less"), F.col(entry)))).alias("r"))  # two at most
        found = checkpointed(found.withColumn("settled", (F.size("r") == 2) | (-F.col("r")[0]["less"] - margin >= t)))
        done = found if t == floor - margin else found.where("settled")
        seen = done if seen is None else seen.unionByName(done)
        left = checkpointed(left.join(found.where("settled"), text, "left_anti"))
    two = seen.select(text, F.col("r")[0][entry].alias(entry), (-F.col("r")[0]["less"]).alias("ratio"), (-F.get("r", F.lit(1))["less"]).alias("next"))
    return two.where((F.col("ratio") >= floor) & (F.col("next").isNull() | (F.col("ratio") - F.col("next") >= margin - 1e-9))).select(text, entry, "ratio")
