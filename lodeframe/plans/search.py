"""Queries of catalogue search: filters, text, ranking, windows and samples."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import holds_near, indel_similarity, sequence_similarity
from ..operators import naming as N
from ..operators import search as S
from ..session import shared_folder
from ..sources import index as X
from .registry import Inputs, query

TAGS = "string_split(tag_list, ',')"
SEARCHABLE = "trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(lower({0}), '[\\(\\[].*?[\\)\\]]', '', 'g'), '-', ' '), '’', ''''), '[!-/:-@\\[-`{{-~]', '', 'g'), '[0-9]', '', 'g'), '\\s+', ' ', 'g'))"
DISPLAY = "select c.*, p.set_code, p.number, p.border, p.artist, p.full_art, p.pk as printing_pk from cards c left join printings p on p.pk = coalesce(c.canonical_pk, case when c.status = 'RESOLVED' then c.inferred_pk end)"


def cards(i: Inputs) -> DataFrame:
    return i.cards.withColumn("tags", F.split("tag_list", ","))


def documents(i: Inputs) -> DataFrame:
    """The denormalised search documents: rows with the attributes of their resolved printing."""
    p = i.printings.select(F.col("pk").alias("printing_pk"), "set_code", "number", "border", "artist", "full_art")
    c = cards(i).withColumn("printing_key", F.coalesce("canonical_pk", F.when(F.col("status") == "RESOLVED", F.col("inferred_pk"))))
    return c.join(p, c.printing_key == p.printing_pk, "left").drop("printing_key")


@query("src_13_search_documents", f"select pk, {SEARCHABLE.format('name')} as searchq, card_type, source_pk, language, set_code, number, border, artist from ({DISPLAY})")
def _(i):
    return searchable_documents(i)


def searchable_documents(i: Inputs) -> DataFrame:
    return documents(i).select("pk", T.searchable(F.col("name")).alias("searchq"), "card_type", "source_pk", "language", "set_code", "number", "border", "artist")


@query("src_13_indexed_documents", f"select pk, {SEARCHABLE.format('name')} as searchq, card_type, source_pk, language, set_code, number, border, artist from ({DISPLAY})")
def _(i):
    """All documents through the sink, and back from what it shows."""
    docs, path = searchable_documents(i), f"{shared_folder(i.spark)}/index-{uuid.uuid4().hex}"
    X.index_documents(docs, path, "pk")
    return X.indexed(i.spark, path, docs.schema, "pk")


@query("src_14_reindexed_documents", f"select pk, case when pk in (7, 11) then concat('again ', {SEARCHABLE.format('name')}) else {SEARCHABLE.format('name')} end as searchq, card_type, source_pk, language, set_code, number, border, artist from ({DISPLAY}) where pk <> 13")
def _(i):
    """Single rows updated twice and removed behind a full index; an update without a key is logged and changes nothing."""
    docs, path = searchable_documents(i), f"{shared_folder(i.spark)}/index-{uuid.uuid4().hex}"
    X.index_documents(docs, path, "pk")
    for pk, prefix in ((7, "once "), (7, "again "), (11, "again ")):
        X.reindexed(docs.where(F.col("pk") == pk).withColumn("searchq", F.concat(F.lit(prefix), "searchq")), path, "pk")
    X.removed(docs.where("pk = 13"), path, "pk")
    X.reindexed(docs.where("pk = 17").withColumn("pk", F.lit(None).cast("long")).withColumn("searchq", F.lit("lost")), path, "pk")
    return X.indexed(i.spark, path, docs.schema, "pk")


@query("flt_1_structured_search", f"select pk from cards where source_pk in (1, 2, 3, 5, 8, 13) and dpi between 200 and 1200 and size <= 30000000 and card_type in ('CARD', 'TOKEN') and lower(language) in ('en', 'fr') and list_has_any({TAGS}, ['ring', 'red', 'bolt']) and not list_has_any({TAGS}, ['promo'])")
def _(i):
    s = S.Settings(sources=[1, 2, 3, 5, 8, 13], dpi=(200, 1200), types=["CARD", "TOKEN"], languages=["EN", "FR"], include_tags=["ring", "red", "bolt"], exclude_tags=["promo"])
    return cards(i).where(S.matches(s)).select("pk")


@query("flt_2_query_terms", f"select pk from ({DISPLAY}) where coalesce(lower(artist) like '%promo%', false) and not coalesce(lower(border) = 'white', false) and coalesce(upper(set_code) <> 'S3', true)")
def _(i):
    q = T.parse_query('a:promo -border:White -set:"s3" frame:""')
    return documents(i).where(S.terms_filter(q.terms)).select("pk")


@query("flt_3_unknown_passes", f"select pk from ({DISPLAY}) where printing_pk is null or (full_art and border = 'borderless')")
def _(i):
    return documents(i).where(S.unknown_passes(F.col("printing_pk").isNotNull(), F.col("full_art") & (F.col("border") == "borderless"))).select("pk")


@query("flt_4_tags_contain_or_contained", f"select pk from cards, (select 1) where (list_has_all({TAGS}, ['red', 'ring']) or list_has_all(['red', 'ring'], list_filter({TAGS}, lambda t: t <> ''))) and not list_has_any({TAGS}, ['large'])")
def _(i):
    tags = F.filter("tags", lambda t: t != "")
    return cards(i).where(S.tags_related(tags, ["red", "ring"], ["large"])).select("pk")


@query("flt_5_all_words", "select pk from cards where contains(lower(name), 'red') and contains(lower(name), 'rin')")
def _(i):
    return i.cards.where(S.all_words(F.col("name"), "red rin")).select("pk")


@query("flt_6_recent", "select pk, ts from votes where ts >= timestamp '2024-01-31 00:00:00' - interval '14' day and ts < timestamp '2024-01-31 00:00:00'")
def _(i):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return i.votes.where((F.col("ts") >= now - F.expr("interval 14 days")) & (F.col("ts") < now)).select("pk", "ts")


@query("flt_7_eligible", f"select pk from cards c where status = 'UNRESOLVED' and canonical_pk is null and card_type = 'CARD' and not (dpi < 200 and dpi is not null) and not list_contains({TAGS}, 'old') and not list_contains({TAGS}, 'rod') and not exists (select 1 from scans s where s.card_pk = c.pk and s.engine = 'engine1' and s.reason <> 'no-text')")
def _(i):
    done = i.scans.where("engine = 'engine1' and reason <> 'no-text'").select(F.col("card_pk").alias("pk"))
    c = cards(i).where("status = 'UNRESOLVED' and canonical_pk is null and card_type = 'CARD' and (dpi is null or dpi >= 200)")
    return c.where(~F.array_contains("tags", "old") & ~F.array_contains("tags", "rod")).select("pk").join(done, "pk", "left_anti")


@query("flt_8_map_any_value", "select entity from (select entity, candidate, count(distinct polarity) as n from votes group by 1, 2) group by 1 having bool_or(n > 1)")
def _(i):
    one = i.votes.groupBy("entity", "candidate").agg(F.when(F.countDistinct("polarity") > 1, "contested").otherwise("clear").alias("s"))
    m = one.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("candidate", "s"))).alias("statuses"))
    return m.where(F.exists(F.map_values("statuses"), lambda v: v == "contested")).select("entity")


@query("flt_9_scalar_or_element", "select pk from printings where illustration = 5 or pk % 97 = 11 or pk % 41 = 5")
def _(i):
    faces = F.array(F.struct((F.col("pk") % 41).alias("illustration")), F.struct((F.col("pk") % 97 - 6).alias("illustration")))
    p = i.printings.withColumn("faces", faces)
    return p.where((F.col("illustration") == 5) | F.exists("faces", lambda f: f["illustration"] == 5)).select("pk")


@query("flt_10_manifest_subset", "select pk from cards where priority % 3 = 1 and created_day % 2 = 0")
def _(i):
    c = i.cards.withColumn("versions", F.create_map(F.lit("ocr"), (F.col("priority") % 3).cast("int"), F.lit("hash"), (F.col("created_day") % 2).cast("int"), F.lit("old"), F.lit(9)))
    expected = F.create_map(F.lit("ocr"), F.lit(1), F.lit("hash"), F.lit(0))
    return c.where(F.forall(F.map_entries(expected), lambda e: F.coalesce(F.try_element_at("versions", e["key"]) == e["value"], F.lit(False)))).select("pk")


@query("flt_12_current_evidence", "select e.pk from evidence e join cards c on c.pk = e.card_pk where c.phash is not null and e.content_hash = c.phash % 50 and (c.md5 is null or e.set_code = '' or c.md5 <> '')")
def _(i):
    c = i.cards.select(F.col("pk").alias("card_pk"), "md5", "phash").where("phash is not null")
    live = (F.col("content_hash") == F.col("phash") % 50) & (F.col("md5").isNull() | (F.col("set_code") == "") | (F.col("md5") != ""))
    return i.evidence.join(c, "card_pk").where(live).select("pk")


@query("flt_13_justified", f"select pk from cards where list_has_any({TAGS}, ['ring', 'gear']) and priority >= 6")
def _(i):
    return cards(i).where(F.arrays_overlap("tags", F.array(F.lit("ring"), F.lit("gear"))) & (F.col("priority") >= 6)).select("pk")


@query("flt_14_pairs_and_sources", f"select pk from ({DISPLAY}) where (set_code, number) in (('s1', '010'), ('s2', '020'), ('s5', '005'), ('s3', '012')) or source_pk = 1")
def _(i):
    pairs = i.spark.createDataFrame([("s1", "010"), ("s2", "020"), ("s5", "005"), ("s3", "012")], "set_code string, number string")
    d = documents(i)
    return d.join(pairs, ["set_code", "number"], "left_semi").select("pk").union(d.where("source_pk = 1").select("pk")).distinct()


PRECEDENCE = "case when p.artist is not null and c.canonical_pk is not null then 'confirmed' when q.artist is not null and c.status = 'RESOLVED' then 'inferred' when c.expansion_hint <> '' then 'hint' else 'none' end"


@query("prj_1_precedence_chain", f"select c.pk, coalesce(p.artist, case when c.status = 'RESOLVED' then q.artist end, nullif(c.expansion_hint, ''), '') as artist, {PRECEDENCE} as artist_source from cards c left join printings p on p.pk = c.canonical_pk left join printings q on q.pk = c.inferred_pk")
def _(i):
    p = i.printings
    one = p.select(F.col("pk").alias("canonical_pk"), F.col("artist").alias("a1"))
    two = p.select(F.col("pk").alias("inferred_pk"), F.col("artist").alias("a2"))
    c = i.cards.join(one, "canonical_pk", "left").join(two, "inferred_pk", "left")
    inferred = F.when(F.col("status") == "RESOLVED", F.col("a2"))
    hint = F.nullif("expansion_hint", F.lit(""))
    source = F.when(F.col("a1").isNotNull(), "confirmed").when(inferred.isNotNull(), "inferred").when(hint.isNotNull(), "hint").otherwise("none")
    return c.select("pk", F.coalesce("a1", inferred, hint, F.lit("")).alias("artist"), source.alias("artist_source"))


@query("prj_2_status_gated", f"select pk, upper(set_code) as set_code, lower(border) as border, coalesce(artist, '') as artist from ({DISPLAY})")
def _(i):
    return documents(i).select("pk", F.upper("set_code").alias("set_code"), F.lower("border").alias("border"), F.coalesce("artist", F.lit("")).alias("artist"))


@query("prj_3_first_suggestion", "select entity, outcome as suggestion from (select *, row_number() over (partition by entity order by pk) as rn from votes where source in ('ocr', 'deduction') and not sentinel) where rn = 1")
def _(i):
    return i.votes.where(F.col("source").isin("ocr", "deduction") & ~F.col("sentinel")).groupBy("entity").agg(F.min_by("outcome", "pk").alias("suggestion"))


@query("prj_4_status_map", "select pk, case status when 'RESOLVED' then 'shown' when 'CONTESTED' then 'shown' end as a, case when priority > 6 then 'hidden' end as b from cards")
def _(i):
    m = F.create_map(F.lit("a"), F.col("status"), F.lit("b"), F.when(F.col("priority") > 6, "REJECTED").otherwise("UNRESOLVED"))
    two = F.transform_values(m, lambda k, v: F.when(v.isin("RESOLVED", "CONTESTED"), "shown").when(v == "REJECTED", "hidden"))
    kept = F.map_filter(two, lambda k, v: v.isNotNull())
    return i.cards.select("pk", F.try_element_at(kept, F.lit("a")).alias("a"), F.try_element_at(kept, F.lit("b")).alias("b"))


@query("prj_5_overlay", "select c.pk, coalesce(n, 0) as n_votes, coalesce(sources, '') as sources from cards c left join (select entity, count(*) as n, array_to_string(list_sort(list(distinct source)), ',') as sources from votes group by 1) v on v.entity = c.pk")
def _(i):
    v = i.votes.groupBy(F.col("entity").alias("pk")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("s"))
    return i.cards.select("pk").join(v, "pk", "left").select("pk", F.coalesce("n", F.lit(0)).alias("n_votes"), F.coalesce("s", F.lit("")).alias("sources"))


RAW = "concat(case pk % 3 when 0 then 'a:' when 1 then '-border:' else 'power:' end, base_name, ' tag:\"', name, '\" x', cast(pk as string))"


@query(
    "str_1_parsed_terms",
    f"""with r as (select pk, {RAW} as raw from cards), w as (select pk, raw, unnest(regexp_extract_all(raw, '(?:^|\\s)(-?[A-Za-z]+:(?:"[^"]*"|\\S+))', 1)) as w, generate_subscripts(regexp_extract_all(raw, '(?:^|\\s)(-?[A-Za-z]+:(?:"[^"]*"|\\S+))', 1), 1) as n from r),
    t as (select pk, n, starts_with(w, '-') as negated, case lower(regexp_extract(w, '^-?([A-Za-z]+):', 1)) when 'a' then 'artist' when 'artist' then 'artist' when 'border' then 'border' when 'frame' then 'frame' when 'tag' then 'tag' when 'set' then 'set' when 'lang' then 'lang' end as operator, regexp_replace(regexp_replace(w, '^-?[A-Za-z]+:', ''), '^"([^"]*)"$', '\\1') as value from w)
    select r.pk, concat('[', coalesce(array_to_string(list(concat('{{"negated":', case when negated then 'true' else 'false' end, ',"operator":"', operator, '","value":"', value, '"}}') order by n) filter (where operator is not null), ','), ''), ']') as terms,
    any_value(trim(regexp_replace(regexp_replace(concat(' ', raw), '\\s-?[A-Za-z]+:("[^"]*"|\\S+)', ' ', 'g'), '\\s+', ' ', 'g'))) as text from r left join t on t.pk = r.pk group by r.pk""",
)
def _(i):
    raw = F.concat(F.when(F.col("pk") % 3 == 0, "a:").when(F.col("pk") % 3 == 1, "-border:").otherwise("power:"), "base_name", F.lit(' tag:"'), "name", F.lit('" x'), F.col("pk").cast("string"))
    c = i.cards.select("pk", raw.alias("raw"))
    return c.select("pk", F.to_json(T.query_terms(F.col("raw"))).alias("terms"), T.residual_text(F.col("raw")).alias("text"))


@query("str_2_searchable", f"select pk, {SEARCHABLE.format('name')} as searchq from cards")
def _(i):
    return i.cards.select("pk", T.searchable(F.col("name")).alias("searchq"))


@query("str_3_text_helpers", "select pk, regexp_replace(name, '[\\(\\[].*?[\\)\\]]', '', 'g') as bare, trim(regexp_replace(concat('  ', name, '   x '), '\\s+', ' ', 'g')) as spaced, cast(pk + priority as bigint) as total from cards")
def _(i):
    numbers = T.int_list(F.format_string("[%d, %d]", "pk", "priority"))
    total = F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)
    return i.cards.select("pk", T.strip_brackets(F.col("name")).alias("bare"), T.collapse_spaces(F.concat(F.lit("  "), "name", F.lit("   x "))).alias("spaced"), total.alias("total"))


@query("str_4_exact_folded", "select doc_id from documents where lower(strip_accents(text)) = (select lower(strip_accents(text)) from documents where doc_id = 0)")
def _(i):
    d = i.documents.select("doc_id", T.folded(F.col("text")).alias("k"))
    return d.join(F.broadcast(d.where("doc_id = 0").select("k").distinct()), "k", "left_semi").select("doc_id")


@query("str_5_all_tokens", "select pk from cards where list_has_all(regexp_split_to_array(lower(name), '[^a-z0-9]+'), ['red', 'foil'])")
def _(i):
    return i.cards.where(T.has_all_tokens(T.tokens(F.lower("name")), F.array(F.lit("red"), F.lit("foil")))).select("pk")


@query("str_7_tag_parts", "select pk, case pk % 5 when 0 then 'Full Art' when 1 then 'Foil|Alt' when 3 then '1' else '' end as parts from cards")
def _(i):
    return i.cards.select("pk", F.array_join(T.tag_parts(F.col("name")), "|").alias("parts"))


@query("str_8_removed_tag", "select pk, case pk % 5 when 1 then concat(base_name, ' [Alt]') else name end as name from cards")
def _(i):
    return i.cards.select("pk", T.without_tag(F.col("name"), "Foil").alias("name"))


ANCESTORS = "with recursive up as (select pk, pk as ancestor from tags union all select up.pk, t.parent_pk from up join tags t on t.pk = up.ancestor where t.parent_pk is not null)"


@query("str_9_implied_tags", f"{ANCESTORS}, raw as (select pk, pk % 100 as tag_pk from cards) select r.pk, array_to_string(list_sort(list(concat('tag', cast(ancestor as string)))), ',') as implied from raw r join up on up.pk = r.tag_pk group by 1")
def _(i):
    from ..operators.clustering import ancestors

    up = ancestors(i.tags, "pk", "parent_pk").select(F.col("pk").alias("tag_pk"), F.concat(F.lit("tag"), F.col("ancestor").cast("string")).alias("tag"))
    return i.cards.select("pk", (F.col("pk") % 100).alias("tag_pk")).join(up, "tag_pk").groupBy("pk").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("implied"))


#: Names that hold a printing, a number in braces, an artist, a set alone or tags, each in some rows.
NAMED = "concat(base_name, case pk % 5 when 0 then concat(' [S', cast(pk % 9 as string), ' ', lpad(cast(pk % 50 + 1 as string), 3, '0'), ']') when 1 then concat(' {', lpad(cast(pk % 50 + 1 as string), 3, '0'), '} [S', cast(pk % 9 as string), ', Tag', cast(pk % 61 as string), ']') when 2 then concat(' (', (case pk % 3 when 0 then 'PROMO' when 1 then 'SMALL' else 'PROMO] [SMALL' end), ') [s', cast(pk % 12 as string), ']') when 3 then concat(' [tag', cast(pk % 47 as string), ', alias', cast(pk % 31 as string), ', no such tag]') else '' end)"


@query(
    "str_9_extracted_names",
    f"""with recursive n as (select pk, {NAMED} as name from cards), c as (select pk, nullif(regexp_extract(name, '\\{{([^{{}}]+)\\}}', 1), '') as number, regexp_extract_all(name, '[\\(\\[]([^()\\[\\]]+)[\\)\\]]', 1) as parts from n),
    r as (select distinct pk, number, trim(x) as raw from (select pk, number, unnest(string_split(array_to_string(parts, ','), ',')) as x from c) where trim(x) <> ''),
    k as (select concat(upper(set_code), ' ', number) as label, max(pk) as card_pk from printings group by 1),
    cm as (select r.pk, max(card_pk) as card_pk from r join k on k.label = case when r.number is null then r.raw else concat(r.raw, ' ', r.number) end group by 1 having count(distinct label) = 1),
    ar as (select artist, max(pk) as artist_pk from printings group by 1),
    am as (select r.pk, max(artist_pk) as artist_pk from r join ar on ar.artist = r.raw where r.pk not in (select pk from cm) group by 1 having count(distinct artist) = 1),
    hm as (select r.pk, min(lower(raw)) as hint from r where r.pk not in (select pk from cm) and lower(raw) in (select set_code from printings) group by 1),
    kt as (select low, min_by(pk, kind * 1000000000000 + pk) as tag_pk from (select pk, lower(name) as low, 0 as kind from tags union all select pk, concat('alias', cast(pk * 3 as string)), 1 from tags) group by 1),
    up as (select pk, pk as ancestor from tags union all select up.pk, t.parent_pk from up join tags t on t.pk = up.ancestor where t.parent_pk is not null),
    tg as (select r.pk, array_to_string(list_sort(list(distinct t.name)), ',') as tags from r join kt on kt.low = lower(r.raw) join up on up.pk = kt.tag_pk join tags t on t.pk = up.ancestor group by 1)
    select n.pk, card_pk, artist_pk, hint, coalesce(tags, '') as tags from n left join cm using (pk) left join am using (pk) left join hm using (pk) left join tg using (pk)""",
)
def _(i):
    names = i.cards.selectExpr("pk", f"{NAMED} as name")
    artists = i.printings.groupBy(F.col("artist").alias("name")).agg(F.max("pk").alias("pk"))
    tags = i.tags.select("pk", "name", F.array(F.concat(F.lit("alias"), (F.col("pk") * 3).cast("string"))).alias("aliases"), "parent_pk")
    out = N.extracted(names, "pk", "name", i.printings.select("pk", "set_code", "number"), artists, i.printings.select(F.col("set_code").alias("code")), tags)
    return out.select("pk", "card_pk", "artist_pk", "hint", F.array_join("tags", ",").alias("tags"))


@query("str_10_unique_or_nothing", "select number, case when count(distinct set_code) = 1 then min(set_code) end as set_code from printings group by 1")
def _(i):
    return i.printings.groupBy("number").agg(F.when(F.countDistinct("set_code") == 1, F.min("set_code")).alias("set_code"))


@query("str_11_fuzzy_alias")
def _(i):
    """Near spellings of tags in names, on top of suggestions of which some were rejected or are pending."""
    tags = i.tags.select("pk", "name", F.array(F.concat(F.lit("label "), "name")).alias("aliases"))
    spelt = F.when(F.col("pk") % 3 == 0, F.concat(F.lit("tagg"), (F.col("pk") % 40).cast("string"))).when(F.col("pk") % 3 == 1, F.lit("labl tag")).otherwise(F.col("base_name"))
    raws = i.cards.select(spelt.alias("raw"))
    kinds = F.when(F.col("pk") % 2 == 0, "REJECTED").otherwise("PENDING")
    stored = i.tags.where("pk < 10").select(F.concat(F.lit("tagg"), F.col("pk").cast("string")).alias("raw"), F.col("pk").alias("tag_pk"), F.lit(0.7).alias("ratio"), F.lit(2).cast("long").alias("occurrences"), kinds.alias("status"))
    return N.suggested(raws, tags, stored)


@query("str_12_similarity_ranking")
def _(i):
    return i.cards.select("base_name").distinct().withColumn("ratio", indel_similarity("base_name", F.lit("red ring"))).orderBy(F.desc("ratio"), "base_name")


@query("str_13_sequence_match")
def _(i):
    pairs = i.printings.select("name", "artist").distinct().withColumn("read", F.concat(F.lower("artist"), F.lit("x")))
    return pairs.withColumn("ratio", sequence_similarity(F.lower("artist"), "read")).where("ratio >= 0.8")


@query("str_14_copy_suffix", "select pk, case pk % 5 when 3 then base_name else name end as name, false as interior from cards")
def _(i):
    return i.cards.select("pk", T.without_copy_suffix(F.col("name")).alias("name"), T.interior_capital(F.col("name")).alias("interior"))


@query("str_16_legal_line", "select pk, cast(1993 + pk % 30 as string) as year, pk % 4 = 0 as marked from cards")
def _(i):
    line = F.concat(F.when(F.col("pk") % 2 == 0, "TM & © ").otherwise("Wizened "), (1993 + F.col("pk") % 30).cast("string"), F.when(F.col("pk") % 4 == 0, " NOT FOR SALE").otherwise(" Print Co."))
    return i.cards.select("pk", T.copyright_year(line).alias("year"), T.proxy_marker(line).alias("marked"))


@query("str_17_artist_credit", "select pk, artist from printings")
def _(i):
    return i.printings.select("pk", T.artist_credit(F.concat(F.lit("Illus. "), "artist", F.lit("."))).alias("artist"))


@query("str_18_window_recovery")
def _(i):
    """Names of the catalogue read from lines of small print: whole, misspelt and cut off, narrowed to a row's own where it has some."""
    pk = F.col("pk")
    own = F.when(pk % 3 == 0, F.col("base_name")).when(pk % 3 == 1, F.regexp_replace("base_name", "i", "l")).otherwise(F.expr("substring(base_name, 1, length(base_name) - 3)"))
    lines = i.cards.select("pk", F.concat(F.lit("012/250 C S3 EN "), own).alias("line"))
    allowed = i.cards.where("pk % 4 = 0").select("pk", F.col("base_name").alias("name"))
    return N.recovered(lines, "pk", "line", i.printings.select("name").distinct(), "name", allowed)


@query("str_19_margin_recogniser")
def _(i):
    """The lexicon entry of each name with some letters misread, if it leads the next."""
    names = i.cards.select("base_name").distinct().select("base_name", F.regexp_replace("base_name", "e", "c").alias("read"))
    found = N.recognised(names, "read", names.select(F.col("base_name").alias("entry")), "entry")
    return names.join(found, "read").select("base_name", "entry")


@query("str_20_near_marker", "with b as (select pk, regexp_replace(lower(concat(name, 'l')), '[^a-z0-9]', '', 'g') as b from cards) select pk, len(list_filter(range(1, length(b) - 6), lambda k: hamming(substr(b, k, 8), 'fullart1') <= 1)) > 0 as hit from b")
def _(i):
    return i.cards.select("pk", holds_near(F.concat(F.col("name"), F.lit("l")), "fullart1", 7).alias("hit"))


@query("str_21_declared_tags", "select pk, case pk % 6 when 0 then 'Full Art' when 1 then 'Borderless' when 2 then '' when 3 then 'Showcase' when 4 then '' else 'Extended,Etched' end as tags from cards")
def _(i):
    r = F.col("pk") % 6
    name = F.concat("base_name", F.when(r == 0, " (Fullart)").when(r == 1, " [Borderless]").when(r == 2, " no black border").when(r == 3, " showcase, white-bordered black border").when(r == 4, " etched champion").otherwise(" (Extended) etched foil"))
    return i.cards.select("pk", F.array_join(T.declared_tags(name), ",").alias("tags"))


@query("str_22_boilerplate_key", "select doc_id, case when length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) >= 12 and length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) >= length(regexp_replace(text, '\\s+', '', 'g')) * 0.5 then regexp_replace(lower(text), '[^a-z0-9]', '', 'g') end as key from documents")
def _(i):
    return i.documents.select("doc_id", T.boilerplate_key(F.col("text")).alias("key"))


@query("str_23_autocomplete", "select base_name, case when starts_with(base_name, 're') then 0 else 1 end as tier from (select distinct base_name from cards) where contains(base_name, 're') order by tier, base_name limit 10")
def _(i):
    return S.autocomplete(i.cards, "base_name", "RE")


@query("str_24_calculator_family", "select pk, case when regexp_matches(agent, '^.+-v[0-9]+$') then regexp_replace(agent, '-v[0-9]+$', '') end as family from votes")
def _(i):
    return i.votes.select("pk", T.calculator_family(F.col("agent")).alias("family"))


DECK = "concat(cast(priority + 1 as string), 'x ', case when pk % 3 = 0 then 't:' else '' end, base_name, case pk % 5 when 0 then concat('@img', cast(pk as string)) when 1 then concat(' [mpc:tok', cast(pk as string), '] ') else '' end, case when pk % 4 = 0 then concat(' // back side', case when pk % 8 = 0 then '@b-1' else '' end) else '' end, case when pk % 2 = 0 then concat(' (abc) ', cast(pk as string)) else '' end)"


@query(
    "str_26_deck_lines",
    f"""with l as (select pk, trim(regexp_replace({DECK}, '\\s+', ' ', 'g')) as line from cards), b as (select pk, regexp_replace(line, '^[0-9]+x ', '') as body, cast(regexp_extract(line, '^([0-9]+)x', 1) as int) as quantity from l),
    p as (select *, regexp_replace(regexp_replace(body, '^t:', ''), ' \\(abc\\) [0-9]+$', '') as faces from b),
    f as (select *, trim(string_split(faces, ' // ')[1]) as one, string_split(faces, ' // ')[2] as two from p),
    d as (select lower(name) as k, min(concat('back of ', name)) as b from printings where layout = 'transform' group by 1),
    o as (select *, trim(regexp_replace(regexp_replace(one, '\\[mpc:[^\\]]*\\]', ''), '@.*$', '')) as front from f)
    select pk, quantity, case when starts_with(body, 't:') then 'TOKEN' else 'CARD' end as kind, front, coalesce(nullif(regexp_extract(one, '\\[mpc:([^\\]]*)\\]', 1), ''), nullif(regexp_extract(one, '@(.*)$', 1), '')) as front_id,
    coalesce(regexp_replace(two, '@.*$', ''), d.b) as back, nullif(regexp_extract(two, '@(.*)$', 1), '') as back_id,
    case when pk % 2 = 0 then 'ABC' end as set_code, nullif(regexp_extract(body, ' \\(abc\\) ([0-9]+)$', 1), '') as number from o left join d on d.k = lower(front)""",
)
def _(i):
    lines = i.cards.selectExpr("pk", f"{DECK} as line").select("pk", T.deck_line(F.col("line")).alias("d")).select("pk", "d.*")
    pairs = i.printings.where("layout = 'transform'").select(F.col("name").alias("front"), F.concat(F.lit("back of "), "name").alias("back"))
    return N.with_back_faces(lines, pairs)


@query("str_27_client_searchable", "select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[\\(\\[].*?[\\)\\]]', '', 'g'), '-', ' '), '’', ''''), '[!-/:-@\\[-`{-~]', '', 'g'), '[0-9]', '', 'g'), '\\s+', ' ', 'g')) as k from documents")
def _(i):
    return i.documents.select("doc_id", T.client_searchable(F.col("text")).alias("k"))


@query(
    "str_28_fnv_keys",
    """with q as (select pk, concat('cardType=', card_type, chr(10), '  &query=', case when pk % 7 = 0 then concat(base_name, ' 😀 é日') else base_name end, chr(10), '  &expansionCode=', coalesce(nullif(expansion_hint, ''), 'null'), chr(10), '  &collectorNumber=', case when pk % 3 = 0 then cast(pk as string) else 'null' end) as s from cards),
    u as (select pk, list_transform(string_split(s, ''), lambda x: unicode(x)) as points from q),
    w as (select pk, flatten(list_transform(points, lambda x: case when x < 65536 then [x] else [55296 + ((x - 65536) >> 10), 56320 + ((x - 65536) & 1023)] end)) as units from u)
    select pk, cast(list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(units, lambda x: cast(x as bigint))), lambda h, x: (xor(h, x) * 16777619) & 4294967295) as string) as qkey from w""",
)
def _(i):
    """Keys of searches, some beyond the basic plane, some without set and number."""
    name = F.when(F.col("pk") % 7 == 0, F.concat("base_name", F.lit(" 😀 é日"))).otherwise(F.col("base_name"))
    return i.cards.select("pk", T.query_key(F.col("card_type"), name, F.nullif("expansion_hint", F.lit("")), F.when(F.col("pk") % 3 == 0, F.col("pk").cast("string"))).alias("qkey"))


@query("str_28_query_key", "select distinct base_name, md5(lower(base_name)) as qkey from cards")
def _(i):
    return i.cards.select("base_name", F.md5(F.lower("base_name")).alias("qkey")).distinct()


@query("str_29_language_prefix", "select pk, language, base_name as name from cards")
def _(i):
    raw = F.concat(F.lit("{"), "language", F.lit("} "), "base_name")
    return i.cards.select("pk", T.language_prefix(raw).alias("language"), T.without_language(raw).alias("name"))


ORDER = "order by tier, ordinal, priority desc, pk"


@query("srt_1_ranked_hits", f"with h as (select d.pk, d.priority, s.ordinal, case when upper(set_code) = 'S1' and number = '010' then 0 when upper(set_code) = 'S1' then 1 else 2 end as tier from ({DISPLAY}) d join sources s on s.pk = d.source_pk where contains(lower(d.name), 'ring')) select pk, tier, row_number() over ({ORDER}) as rank from h qualify rank <= 100")
def _(i):
    d = documents(i).where(F.lower("name").contains("ring")).join(i.sources.select(F.col("pk").alias("source_pk"), "ordinal"), "source_pk")
    top = d.withColumn("tier", S.match_tier(F.col("set_code"), F.col("number"), "S1", "010")).orderBy("tier", "ordinal", F.desc("priority"), "pk").limit(100)
    return S.ranked(top, F.col("tier"), F.col("ordinal"), F.desc("priority"), F.col("pk")).select("pk", "tier", "rank")


@query("str_6_unscored_order", "select pk, row_number() over (order by priority desc, source_pk, pk) as rank from cards where contains(base_name, 'bolt') qualify rank <= 50")
def _(i):
    top = i.cards.where(F.col("base_name").contains("bolt")).orderBy(F.desc("priority"), "source_pk", "pk").limit(50)
    return S.ranked(top, F.desc("priority"), F.col("source_pk"), F.col("pk")).select("pk", "rank")


@query("srt_2_degraded_retry", f"with q as (select distinct base_name as q from cards), e as (select base_name as q, pk from ({DISPLAY}) where set_code = 's1' and base_name in (select q from q)), r as (select base_name as q, pk from cards where base_name in (select q from q)) select q, pk, false as degraded from e union all select q, pk, true from r where q not in (select q from e)")
def _(i):
    wanted = i.cards.select("base_name").distinct()
    hits = documents(i).join(wanted, "base_name", "left_semi").withColumnRenamed("base_name", "q")
    return S.degraded(hits.where("set_code = 's1'").select("q", "pk"), hits.select("q", "pk"), "q")


@query("srt_3_page_with_total", "with h as (select pk, name, created_day, count(*) over () as total from cards where contains(name, 'r')) select pk, name, total from h order by created_day desc, name, pk limit 60 offset 120")
def _(i):
    h = i.cards.where(F.col("name").contains("r")).select("pk", "name", "created_day")
    return S.page(h, [F.desc("created_day"), F.col("name"), F.col("pk")], 120, 60).crossJoin(h.agg(F.count("*").alias("total"))).select("pk", "name", "total")


_ORDERS = {"nameAscending": "name", "nameDescending": "name desc", "dateCreatedAscending": "created_day, name", "dateCreatedDescending": "created_day desc, name", "dateModifiedAscending": "modified_day, name", "dateModifiedDescending": "modified_day desc, name"}


@query("srt_3_sort_modes", "with h as (select pk, name, created_day, modified_day, count(*) over () as total from cards where contains(name, 'r')) " + " union all ".join(f"select '{m}' as sort_by, pk, place, total from (select pk, total, cast(row_number() over (order by {o}, pk) as int) as place from h) where place > 30 and place <= 70" for m, o in _ORDERS.items()))
def _(i):
    """The second page in each of the six ways to sort."""
    h = i.cards.where(F.col("name").contains("r"))
    columns = {"name": "name", "date_created": "created_day", "date_modified": "modified_day"}
    pages = [S.explored(h, mode, 30, 40, columns, "pk").withColumn("sort_by", F.lit(mode)) for mode in S.SORTS]
    return reduce(DataFrame.unionByName, pages)


@query("srt_4_multi_key_order", "select c.pk, row_number() over (order by s.ordinal, c.priority desc, s.name, c.name, c.pk) as rank from cards c join sources s on s.pk = c.source_pk where card_type = 'CARDBACK' qualify rank <= 200")
def _(i):
    s = i.sources.select(F.col("pk").alias("source_pk"), "ordinal", F.col("name").alias("source"))
    order = [F.col("ordinal"), F.desc("priority"), F.col("source"), F.col("name"), F.col("pk")]
    return S.ranked(i.cards.where("card_type = 'CARDBACK'").join(s, "source_pk").orderBy(*order).limit(200), *order).select("pk", "rank")


@query("srt_5_nulls_last", "select name, pk, popularity, row_number() over (partition by name order by popularity desc nulls last, pk) as rank from printings qualify rank <= 50")
def _(i):
    top = S.newest(i.printings, ["name"], [F.desc_nulls_last("popularity"), F.col("pk")], 50)
    return top.select("name", "pk", "popularity", F.col("rn").cast("long").alias("rank"))


@query("srt_6_hint_first", "select pk, row_number() over (partition by name order by case when set_code = 's3' then 0 else 1 end, popularity desc nulls last, pk) as rank from printings")
def _(i):
    return S.ranked(i.printings, F.when(F.col("set_code") == "s3", 0).otherwise(1), F.desc_nulls_last("popularity"), F.col("pk"), by=["name"]).select("pk", "rank")


@query("srt_7_contested_queue", "select pk from cards where status <> 'RESOLVED' order by case when status = 'CONTESTED' then 0 else 1 end, created_day desc, name, pk limit 24 offset 48")
def _(i):
    order = [F.when(F.col("status") == "CONTESTED", 0).otherwise(1), F.desc("created_day"), F.col("name"), F.col("pk")]
    return S.page(i.cards.where("status <> 'RESOLVED'"), order, 48, 24).select("pk")


@query("srt_8_priority_tuple", "with u as (select name, count(*) as total, count(*) filter (where pk % 2 = 1) as uncovered, min(popularity) as least from printings group by 1) select c.pk, row_number() over (order by case when c.base_name like 'old%' then 0 else 1 end, case when u.uncovered = u.total then 0 else 1 end, u.uncovered desc, u.least nulls last, u.total, c.pk) as rank from cards c join u on u.name = c.base_name qualify rank <= 100")
def _(i):
    u = i.printings.groupBy(F.col("name").alias("base_name")).agg(F.count("*").alias("total"), F.count_if(F.col("pk") % 2 == 1).alias("uncovered"), F.min("popularity").alias("least"))
    order = [F.when(F.col("base_name").startswith("old"), 0).otherwise(1), F.when(F.col("uncovered") == F.col("total"), 0).otherwise(1), F.desc("uncovered"), F.asc_nulls_last("least"), F.col("total"), F.col("pk")]
    return S.ranked(i.cards.join(u, "base_name").orderBy(*order).limit(100), *order).select("pk", "rank")


@query("srt_9_best_in_window", "select pk, score from (select pk, dpi * (pk % 7) as score from cards where dpi is not null order by pk limit 50) order by score desc, pk limit 1")
def _(i):
    w = i.cards.where("dpi is not null").orderBy("pk").limit(50).select("pk", (F.col("dpi") * (F.col("pk") % 7)).alias("score"))
    return w.orderBy(F.desc("score"), "pk").limit(1)


@query("srt_10_rotated_queue", "with p as (select pk, priority, row_number() over (order by created_day, pk) - 1 as pos from cards where status = 'CONTESTED' qualify pos < 500), t as (select *, ((pos - 100) % 500 + 500) % 500 as turn from p) select pk, row_number() over (order by case when turn < 50 then 0 else 1 end, case when turn < 50 then -priority else 0 end, turn) as rank from t")
def _(i):
    first = i.cards.where("status = 'CONTESTED'").orderBy("created_day", "pk").limit(500)
    p = S.ranked(first, F.col("created_day"), F.col("pk"), name="pos").withColumn("pos", F.col("pos") - 1)
    return S.ranked(S.rotated(p, "pos", 500, 100, 50, "priority"), F.col("key")).select("pk", "rank")


@query("srt_11_strata", "with s as (select pk, least(cast(floor(pk * 10 / (select max(pk) + 1 from cards)) as int), 9) as stratum from cards), r as (select *, row_number() over (partition by stratum order by md5(cast(pk as string)), pk) as rn from s) select pk, stratum from r where rn <= 10")
def _(i):
    top = i.cards.agg(F.max("pk")).first()[0]
    c = S.stratum(i.cards, "pk", 0, top, 10)
    return S.newest(c, ["stratum"], [F.md5(F.col("pk").cast("string").cast("binary")), F.col("pk")], 10).select("pk", "stratum")


@query("srt_12_keyed_sample", "select pk from (select pk from cards order by md5(concat(cast(pk as string), 'n100')), pk limit 100)")
def _(i):
    return S.keyed_sample(i.cards, "pk", 100, F.md5(F.concat(F.col("pk").cast("string"), F.lit("n100")).cast("binary"))).select("pk")


@query("srt_13_sample_by_type", "with r as (select pk, card_type, row_number() over (partition by card_type order by md5(concat('s', cast(pk as string))), pk) as rn from cards) select pk, card_type from r where rn <= case card_type when 'CARD' then 4 else 1 end")
def _(i):
    r = S.newest(i.cards, ["card_type"], [F.md5(F.concat(F.lit("s"), F.col("pk").cast("string")).cast("binary")), F.col("pk")], 4)
    return r.where((F.col("card_type") == "CARD") | (F.col("rn") == 1)).select("pk", "card_type")


@query("srt_14_keyset_page", "select pk from cards where pk > 300 order by pk limit 250")
def _(i):
    return S.after_key(i.cards, "pk", 300, 250).select("pk")


@query("srt_15_default_first", "select language, row_number() over (order by case when language = 'FR' then 0 else 1 end, language) as rank from (select distinct language from cards)")
def _(i):
    return S.ranked(i.cards.select("language").distinct(), F.when(F.col("language") == "FR", 0).otherwise(1), F.col("language")).select("language", "rank")


@query("srt_16_group_order", "with g as (select coalesce('p' || cast(canonical_pk as string), 'none') as version, min(pk) as first_pk, bool_or(canonical_pk is not null) as resolved from cards group by 1) select version, row_number() over (order by case when version = 'p66' then 0 else 1 end, resolved desc, first_pk) as rank from g")
def _(i):
    version = F.coalesce(F.concat(F.lit("p"), F.col("canonical_pk").cast("string")), F.lit("none"))
    g = i.cards.groupBy(version.alias("version")).agg(F.min("pk").alias("first_pk"), F.max(F.col("canonical_pk").isNotNull()).alias("resolved"))
    return S.ranked(g, F.when(F.col("version") == "p66", 0).otherwise(1), F.desc("resolved"), F.col("first_pk")).select("version", "rank")


@query("srt_17_input_order", "select pk, case pk when 77 then 1 when 5 then 2 when 901 then 3 when 12 then 4 end as position from cards where pk in (77, 5, 901, 12)")
def _(i):
    wanted = i.spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (77, 5, 901, 12)])).alias("p", "pk"))
    return i.cards.join(F.broadcast(wanted), "pk").select("pk", (F.col("p") + 1).alias("position"))


@query("srt_18_order_bins", "select pk, cast(floor((row_number() over (partition by card_type, language order by pk) - 1) / 612) as bigint) as bin, (row_number() over (partition by card_type, language order by pk) - 1) % 612 as slot from cards")
def _(i):
    return S.split_bins(i.cards, ["card_type", "language"], "pk", 612).select("pk", "bin", "slot")



@query("win_1_newest_valid", "select card_pk, pk, set_code from (select *, row_number() over (partition by card_pk order by updated_at desc, pk) as rn from evidence where set_code <> '' and not truncated) where rn = 1")
def _(i):
    return S.newest(i.evidence.where("set_code <> '' and not truncated"), ["card_pk"], [F.desc("updated_at"), F.col("pk")], 1).select("card_pk", "pk", "set_code")


@query("win_2_newest_three", "select entity, candidate, pk, rn from (select *, row_number() over (partition by entity, candidate order by ts desc, pk) as rn from votes where outcome <> 'view') where rn <= 3")
def _(i):
    return S.newest(i.votes.where("outcome <> 'view'"), ["entity", "candidate"], [F.desc("ts"), F.col("pk")], 3).select("entity", "candidate", "pk", F.col("rn").cast("long").alias("rn"))


@query("win_3_interleaved", "with q as (select entity, candidate, abs(sum(polarity)) as net from votes group by 1, 2) select entity, candidate, row_number() over (partition by entity order by net, candidate) as nth, cast(min(net * 1000 + entity) over (partition by entity) as bigint) as first_position from q")
def _(i):
    q = i.votes.groupBy("entity", "candidate").agg(F.abs(F.sum("polarity")).alias("net"))
    n = S.interleaved(q, "entity", [F.col("net"), F.col("candidate")], F.col("net") * 1000 + F.col("entity"))
    return n.select("entity", "candidate", "nth", "first_position").orderBy("nth", "first_position", "entity")


@query("win_7_ring_of_five", "select pk from (select pk, row_number() over (partition by agent order by ts desc, pk desc) as rn from votes where agent is not null) where rn <= 5")
def _(i):
    return S.newest(i.votes.where("agent is not null"), ["agent"], [F.desc("ts"), F.desc("pk")], 5).select("pk")


@query("win_8_first_wins", "select agent, pk from (select agent, pk, row_number() over (partition by agent order by entity, pk) as rn from votes where agent is not null) where rn = 1")
def _(i):
    return i.votes.where("agent is not null").groupBy("agent").agg(F.min_by("pk", F.struct("entity", "pk")).alias("pk"))


@query("win_9_running_totals", "select source_pk, pk, cast(sum(size) over (partition by source_pk order by pk rows unbounded preceding) as bigint) as total, cast(floor(cast(sum(size) over (partition by source_pk order by pk rows unbounded preceding) - size as double) / 100000000) as bigint) as bin from cards")
def _(i):
    summed = S.running_sum(i.cards, ["source_pk"], "pk", F.col("size"), "total")
    return summed.select("source_pk", "pk", "total", F.floor((F.col("total") - F.col("size")) / 100000000).alias("bin"))
