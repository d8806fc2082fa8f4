"""Queries of the statistics panels and the set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators.search import rolling_sum
from .registry import query

SUMS = "select source_pk as pk, count(*) as qty, cast(sum(dpi) as bigint) as total_dpi, cast(sum(size) as bigint) as total_size from cards group by 1"


@query("agg_1_contributions", f"with c as ({SUMS}) select pk, s.name, coalesce(qty, 0) as qty, coalesce(total_dpi, 0) as total_dpi, coalesce(total_size, 0) as total_size from sources s left join c using (pk)")
def _(i):
    return S.contributions(i.sources, i.cards, "pk", "source_pk", "dpi", "size").select("pk", "name", "qty", "total_dpi", "total_size")


@query("agg_1_contributions_by_type", "select source_pk, card_type, count(*) as qty from cards group by 1, 2")
def _(i):
    return i.cards.groupBy("source_pk", "card_type").agg(F.count("*").alias("qty"))


@query("agg_2_truncated_mean", f"with c as ({SUMS}) select pk, case when coalesce(qty, 0) > 0 then cast(floor(total_dpi / qty) as bigint) else 0 end as avg_dpi from sources left join c using (pk)")
def _(i):
    c = S.contributions(i.sources, i.cards, "pk", "source_pk", "dpi", "size")
    return c.select("pk", S.truncated_mean(F.col("total_dpi"), F.col("qty")).cast("long").alias("avg_dpi"))


@query("agg_4_filtered_distinct", "select source_pk, count(distinct base_name) filter (where card_type = 'CARD') as n_cards, count(distinct base_name) filter (where card_type = 'TOKEN') as n_tokens, count(distinct base_name) filter (where card_type = 'CARDBACK') as n_backs from cards group by 1")
def _(i):
    one = lambda t: F.countDistinct(F.when(F.col("card_type") == t, F.col("base_name")))
    return i.cards.groupBy("source_pk").agg(one("CARD").alias("n_cards"), one("TOKEN").alias("n_tokens"), one("CARDBACK").alias("n_backs"))


@query("agg_5_weekly_buckets", "select cast(date_trunc('week', ts) as timestamp) as week, outcome, count(*) as n from votes where source in ('user', 'admin', 'federated') and ts >= timestamp '2024-01-08 00:00:00' group by 1, 2")
def _(i):
    human = i.votes.where(F.col("source").isin("user", "admin", "federated"))
    return S.weekly(human, "ts", "outcome", F.lit("2024-01-08 00:00:00").cast("timestamp"))


@query("agg_6_skip_breakdown", "select reason, null as engine, count(*) as n from scans where reason <> '' group by 1 union all select reason, engine, count(*) from scans where reason <> '' group by 1, 2")
def _(i):
    return S.breakdown(i.scans.where("reason <> ''"), "reason", "engine").select("reason", "engine", "n")


@query("agg_7_run_history", "with r as (select run_id, min(ts) as started, case when cast(regexp_extract(run_id, '[0-9]+', 0) as bigint) % 4 = 0 then null else max(ts) end as finished from scans group by 1) select run_id, started, cast(floor(epoch(finished)) - floor(epoch(started)) as bigint) as seconds from r order by started desc, run_id limit 10")
def _(i):
    runs = i.scans.groupBy("run_id").agg(F.min("ts").alias("started"), F.max("ts").alias("last"))
    open_run = F.regexp_extract("run_id", "[0-9]+", 0).cast("long") % 4 == 0
    return S.history(runs.withColumn("finished", F.when(~open_run, F.col("last"))), "started", "finished", 10, "run_id").select("run_id", "started", "seconds")


@query("agg_8_participation", "with a as (select distinct entity as e from votes where entity is not null), b as (select distinct card_pk as e from scans where card_pk is not null) select (select count(*) from (select e from a union select e from b)) as n_any, (select count(*) from (select e from a intersect select e from b)) as n_all")
def _(i):
    return S.participation([(i.votes, "entity"), (i.scans, "card_pk")])


@query("agg_8_checksum_groups", "with g as (select md5, count(*) as n, sum(size) as total, max(size) as top from cards where md5 is not null and md5 <> '' group by 1 having count(*) > 1) select count(*) as n_groups, cast(coalesce(sum(n), 0) as bigint) as n_rows, cast(coalesce(sum(total - top), 0) as bigint) as spare_bytes from g")
def _(i):
    return S.duplicate_groups(i.cards, "md5", "size")


@query("agg_9_composition", "select source_type, card_type, count(*) as n, cast(sum(size) as bigint) as bytes from cards join sources s on s.pk = source_pk group by 1, 2")
def _(i):
    return i.cards.join(i.sources.select(F.col("pk").alias("source_pk"), "source_type"), "source_pk").groupBy("source_type", "card_type").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"))


@query("agg_23_four_buckets", "with v as (select entity, bool_or(source in ('ocr', 'deduction')) as machine, bool_or(source in ('user', 'admin')) as human, count(distinct outcome) as n from votes group by 1), f as (select c.pk, coalesce(machine, false) as machine, coalesce(human, false) as human, coalesce(n, 0) as n from cards c left join v on entity = c.pk where status <> 'RESOLVED') select count(*) filter (where machine and not human) as confirmable, count(*) filter (where n > 1) as contested, count(*) filter (where n = 0) as fresh, count(*) as total from f")
def _(i):
    v = i.votes.groupBy(F.col("entity").alias("pk")).agg(F.max(F.col("source").isin("ocr", "deduction")).alias("machine"), F.max(F.col("source").isin("user", "admin")).alias("human"), F.countDistinct("outcome").alias("n"))
    f = i.cards.where("status <> 'RESOLVED'").select("pk").join(v, "pk", "left").fillna(False, ["machine", "human"]).fillna(0, ["n"])
    return f.agg(F.count_if(F.col("machine") & ~F.col("human")).alias("confirmable"), F.count_if(F.col("n") > 1).alias("contested"), F.count_if(F.col("n") == 0).alias("fresh"), F.count("*").alias("total"))


@query("agg_24_served_mix_ratio", "select agent, round(count(*) filter (where outcome in ('click', 'purchase')) / count(*), 6) as ratio from votes where agent is not null group by 1")
def _(i):
    return S.ratio(i.votes.where("agent is not null"), "agent", F.col("outcome").isin("click", "purchase")).withColumn("ratio", F.round("ratio", 6))


@query("agg_25_funnel", "with f as (select entity, bool_or(outcome = 'view') as viewed, bool_or(outcome = 'click') as clicked, bool_or(outcome = 'purchase') as bought, bool_or(outcome = 'purchase' and source in ('user', 'admin')) as bought_by_human from votes group by 1) select count(*) filter (where viewed) as viewed, count(*) filter (where clicked) as clicked, count(*) filter (where bought) as bought, count(*) filter (where bought_by_human) as bought_by_human from f")
def _(i):
    o = F.col("outcome")
    return S.distinct_where(i.votes, "entity", {"viewed": o == "view", "clicked": o == "click", "bought": o == "purchase", "bought_by_human": (o == "purchase") & F.col("source").isin("user", "admin")})


@query("agg_26_covered_set", "select canonical_pk as printing_pk from cards where canonical_pk is not null union select inferred_pk from cards where inferred_pk is not null and status = 'RESOLVED'")
def _(i):
    c = i.cards
    return c.where("canonical_pk is not null").select(F.col("canonical_pk").alias("printing_pk")).union(c.where("inferred_pk is not null and status = 'RESOLVED'").select("inferred_pk")).distinct()


@query("agg_27_hard_names", "with s as (select base_name, count(distinct card_pk) as n from scans join cards on card_pk = cards.pk group by 1 having count(distinct card_pk) >= 5) select base_name, n from s where base_name not in (select base_name from votes join cards on entity = cards.pk where outcome = 'signup' and candidate = 3 and source = 'admin')")
def _(i):
    names = i.cards.select("pk", "base_name")
    scanned = i.scans.select("card_pk").join(names.withColumnRenamed("pk", "card_pk"), "card_pk")
    voted = i.votes.where("outcome = 'signup' and candidate = 3 and source = 'admin'").select(F.col("entity").alias("pk")).join(names, "pk")
    return S.hard_names(scanned, voted, "base_name", "card_pk", 5)


@query("agg_28_least_rank_by_name", "select lower(name) as key, min(popularity) as least from printings where popularity is not null group by 1")
def _(i):
    return S.least_by_key(i.printings, F.col("name"), "popularity")


@query("agg_31_divergence", "select phash, count(*) as n, count(distinct language) as n_values, array_to_string(list_sort(list(distinct language)), ',') as seen from cards where phash is not null group by 1 having count(*) >= 2 and count(distinct language) > 1")
def _(i):
    return S.divergence(i.cards, "phash", "language").withColumn("seen", F.array_join("seen", ","))


@query("agg_32_channel_counts", "select regexp_replace(agent, '-v[0-9]+$', '') as channel, count(*) filter (where polarity > 0) as positive, count(*) filter (where polarity < 0) as negative, count(*) as lifetime, count(*) filter (where run_id = 'run4') as in_run from votes where source in ('ocr', 'deduction') group by 1")
def _(i):
    v = i.votes.where(F.col("source").isin("ocr", "deduction")).withColumn("channel", F.regexp_replace("agent", "-v[0-9]+$", ""))
    return S.conditional_counts(v, ["channel"], {"positive": F.col("polarity") > 0, "negative": F.col("polarity") < 0, "lifetime": F.lit(True), "in_run": F.col("run_id") == "run4"})


@query("agg_33_gate_metrics", "with c as (select run_id, count(*) filter (where reason <> 'unknown-set') as total, count(*) filter (where reason = '') as good from scans group by 1) select run_id, total, good, case when total = 0 then 'INSUFFICIENT' when good / total >= 0.25 then 'PASS' else 'FAIL' end as gate from c")
def _(i):
    c = S.conditional_counts(i.scans, ["run_id"], {"total": F.col("reason") != "unknown-set", "good": F.col("reason") == ""})
    return c.withColumn("gate", S.gate(F.col("total"), F.col("good"), 0.25))


@query("agg_35_pending_first_seen", "select entity, candidate, count(*) as n, min(ts) as first_seen from votes where outcome = 'error' group by 1, 2")
def _(i):
    return i.votes.where("outcome = 'error'").groupBy("entity", "candidate").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))


@query("agg_36_bytes_by_type", "select round(cast(coalesce(sum(size) filter (where card_type = 'CARD'), 0) as double) / 1e9, 6) as cards_gb, round(cast(coalesce(sum(size) filter (where card_type = 'CARDBACK'), 0) as double) / 1e9, 6) as backs_gb, round(cast(coalesce(sum(size) filter (where card_type = 'TOKEN'), 0) as double) / 1e9, 6) as tokens_gb from cards")
def _(i):
    gb = lambda t: F.round(F.coalesce(F.sum(F.when(F.col("card_type") == t, F.col("size"))), F.lit(0)) / 1e9, 6)
    return i.cards.agg(gb("CARD").alias("cards_gb"), gb("CARDBACK").alias("backs_gb"), gb("TOKEN").alias("tokens_gb"))


@query("agg_37_version_stamp", "select max(pk) as max_key, count(*) as n, count(phash) as n_set, cast(sum(size) as bigint) as total from cards")
def _(i):
    return S.version_stamp(i.cards, "pk", "phash", "size")


@query("agg_38_deck_quantities", "select base_name, count(*) as n, concat(cast(count(*) as string), 'x ', base_name) as line from cards where card_type = 'CARD' group by 1")
def _(i):
    return i.cards.where("card_type = 'CARD'").groupBy("base_name").agg(F.count("*").alias("n")).withColumn("line", F.concat(F.col("n").cast("string"), F.lit("x "), "base_name"))


@query("agg_39_slots_by_image", "select l_partkey % 2 = 0 as front, l_partkey as image, array_to_string(list_sort(list(distinct l_linenumber)), ',') as slots from lineitem where l_partkey <> 1 group by 1, 2")
def _(i):
    g = i.lineitem.where("l_partkey <> 1").groupBy((F.col("l_partkey") % 2 == 0).alias("front"), F.col("l_partkey").alias("image")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("slots"))
    return g.withColumn("slots", F.array_join(F.transform("slots", lambda x: x.cast("string")), ","))


@query("agg_40_version_groups", "with g as (select pk, dpi, coalesce('p' || cast(canonical_pk as string), case when inferred_pk is not null then 'suggested' else 'unknown' end) as version, canonical_pk is not null as resolved from cards), r as (select *, row_number() over (partition by version order by coalesce(dpi, 0) desc, resolved desc, pk) as rn, count(*) over (partition by version) as n from g) select version, n, pk as representative from r where rn = 1")
def _(i):
    version = F.coalesce(F.concat(F.lit("p"), F.col("canonical_pk").cast("string")), F.when(F.col("inferred_pk").isNotNull(), "suggested").otherwise("unknown"))
    best = F.max(F.struct(F.coalesce("dpi", F.lit(0)), F.col("canonical_pk").isNotNull(), -F.col("pk")))
    return i.cards.groupBy(version.alias("version")).agg(F.count("*").alias("n"), best.alias("b")).select("version", "n", (-F.col("b.col3")).alias("representative"))


@query("agg_41_resolved_lookup", "select c.pk, p.set_code, p.number, coalesce(p.full_art, false) as full_art, coalesce(p.border, '') as border from cards c left join printings p on p.pk = coalesce(c.canonical_pk, c.inferred_pk) where c.status = 'RESOLVED'")
def _(i):
    p = i.printings.select(F.col("pk").alias("k"), "set_code", "number", "full_art", "border")
    c = i.cards.where("status = 'RESOLVED'").select("pk", F.coalesce("canonical_pk", "inferred_pk").alias("k"))
    return c.join(p, "k", "left").select("pk", "set_code", "number", F.coalesce("full_art", F.lit(False)).alias("full_art"), F.coalesce("border", F.lit("")).alias("border"))


@query("agg_43_cluster_signals", "select content_hash as cluster, kind, value, count(*) as n from (select content_hash, 'border' as kind, border as value from evidence where border <> '' union all select content_hash, 'artist', artist from evidence where artist <> '') group by 1, 2, 3 having count(*) >= 2")
def _(i):
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("border", "artist")]))
    return i.evidence.select(F.col("content_hash").alias("cluster"), pairs.alias("p")).select("cluster", "p.*").where("value <> ''").groupBy("cluster", "kind", "value").agg(F.count("*").alias("n")).where("n >= 2")


@query("flt_11_filled_fields", "select 'md5' as field, count(*) filter (where md5 is not null and md5 <> '') as n_filled from cards union all select 'phash', count(phash) from cards union all select 'expansion_hint', count(*) filter (where expansion_hint <> '') from cards")
def _(i):
    return S.filled(i.cards, ["md5", "phash", "expansion_hint"])


@query("set_1_union_distinct", "select entity as pk from votes union select card_pk from scans")
def _(i):
    return i.votes.select(F.col("entity").alias("pk")).union(i.scans.select("card_pk")).distinct()


@query("set_2_union_all_counts", "select kind, count(*) as n from (select 'part' as kind from part union all select 'supplier' from supplier) group by 1")
def _(i):
    return i.part.select(F.lit("part").alias("kind")).unionAll(i.supplier.select(F.lit("supplier"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("set_3_differences", "(select entity as pk, 'created' as op from votes except select card_pk, 'created' from scans) union all (select card_pk, 'deleted' from scans except select entity, 'deleted' from votes)")
def _(i):
    a, b = i.votes.select(F.col("entity").alias("pk")).distinct(), i.scans.select(F.col("card_pk").alias("pk")).distinct()
    return a.join(b, "pk", "left_anti").withColumn("op", F.lit("created")).unionByName(b.join(a, "pk", "left_anti").withColumn("op", F.lit("deleted")))


@query("set_4_intersection", "select entity as pk from votes intersect select card_pk from scans")
def _(i):
    """Each side shrinks to a row a key before the shuffle: a join would hold every row of a key at once."""
    sides = i.votes.select(F.col("entity").alias("pk"), F.lit(1).alias("side")).unionByName(i.scans.select(F.col("card_pk").alias("pk"), F.lit(2).alias("side")))
    return sides.groupBy("pk").agg(F.bit_or("side").alias("sides")).where("sides = 3").select("pk")


@query("scl_1_week_truncation", "select pk, cast(date_trunc('week', ts) as timestamp) as week from votes")
def _(i):
    return i.votes.select("pk", F.date_trunc("week", "ts").alias("week"))


@query("scl_2_intervals", "select pk, ts + interval '14' day as due, ts - interval '3' hour as before from votes")
def _(i):
    return i.votes.select("pk", (F.col("ts") + F.expr("interval 14 days")).alias("due"), (F.col("ts") - F.expr("interval 3 hours")).alias("before"))


@query("scl_3_durations", "select o_orderkey, cast(epoch(timestamp '2002-01-01 00:00:00') - epoch(o_orderdate) as bigint) as seconds from orders")
def _(i):
    return i.orders.select("o_orderkey", (F.unix_timestamp(F.lit("2002-01-01 00:00:00").cast("timestamp")) - F.unix_timestamp("o_orderdate")).alias("seconds"))


@query("scl_4_half_even", "select pk, cast(10 * round_even(priority * 25 * 10 / 100.0, 0) as bigint) as dpi from cards")
def _(i):
    return i.cards.select("pk", (10 * F.bround(F.col("priority") * 25 * 10 / 100.0, 0)).cast("long").alias("dpi"))


@query("scl_5_formats", "select pk, format('{:,}', size) as grouped, printf('%.2f', size / 1000000.0) as mb from cards")
def _(i):
    return i.cards.select("pk", F.format_number("size", 0).alias("grouped"), F.format_string("%.2f", F.col("size") / F.lit(1e6)).alias("mb"))


@query("scl_6_math", "select pk, round(ln(size), 6) as ln_size, round(sqrt(size), 6) as root, abs(priority - 6) as off, least(priority, 5) as low, greatest(priority, 5) as high, cast(ceil(size / 7.0) as bigint) as parts from cards")
def _(i):
    c = F.col
    return i.cards.select("pk", F.round(F.log("size"), 6).alias("ln_size"), F.round(F.sqrt("size"), 6).alias("root"), F.abs(c("priority") - 6).alias("off"), F.least(c("priority"), F.lit(5)).alias("low"), F.greatest(c("priority"), F.lit(5)).alias("high"), F.ceil(c("size") / 7.0).alias("parts"))


@query("scl_7_arrays", "select pk, array_to_string(list_sort(list_distinct(string_split(tag_list, ','))), '|') as sorted, list_contains(string_split(tag_list, ','), 'ring') as ring, len(list_intersect(string_split(tag_list, ','), ['red', 'ring', 'promo'])) as n from cards")
def _(i):
    t = F.split("tag_list", ",")
    return i.cards.select("pk", F.array_join(F.array_sort(F.array_distinct(t)), "|").alias("sorted"), F.array_contains(t, "ring").alias("ring"), F.size(F.array_intersect(t, F.array(F.lit("red"), F.lit("ring"), F.lit("promo")))).cast("long").alias("n"))


@query("scl_8_merged_counters", "select pk, 5 as cast_votes, priority as skipped from cards")
def _(i):
    merged = F.map_from_entries(F.array_union(F.filter(F.map_entries(F.create_map(F.lit("cast"), F.lit(1), F.lit("skipped"), F.col("priority").cast("int"))), lambda e: e["key"] != "cast"), F.map_entries(F.create_map(F.lit("cast"), F.lit(5)))))
    return i.cards.select("pk", merged["cast"].alias("cast_votes"), merged["skipped"].alias("skipped"))


@query("scl_9_scope_hash", "select pk, sha256(concat_ws('|', identifier, card_type, cast(priority as string))) as scope from cards")
def _(i):
    return i.cards.select("pk", F.sha2(F.concat_ws("|", "identifier", "card_type", F.col("priority").cast("string")), 256).alias("scope"))


@query("scl_10_clean_urls", "select page_id, case when regexp_matches(trim(url), '^https?://[^/?#]+') then trim(url) end as clean, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) as host from pages")
def _(i):
    u = F.trim("url")
    return i.pages.select("page_id", F.when(u.rlike("^https?://[^/?#]+"), u).alias("clean"), F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)).alias("host"))


@query("scl_11_elapsed", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, cast(floor(value * 60) as bigint) // 3600 as h, cast(floor(value * 60) as bigint) % 3600 // 60 as m, cast(floor(value * 60) as bigint) % 60 as s from events")
def _(i):
    t = F.floor(F.col("value") * 60)
    return i.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.floor(t / 3600).alias("h"), F.floor(t % 3600 / 60).alias("m"), (t % 60).alias("s"))


@query("win_6_rolling_failures", "select pk, count(*) filter (where sentinel) over (partition by source order by pk rows between 499 preceding and current row) as failures from votes")
def _(i):
    """The log's own number orders it."""
    return rolling_sum(i.votes.select("pk", "source", "sentinel"), ["source"], "pk", F.col("sentinel").cast("long"), 500, "failures").select("pk", "failures")
