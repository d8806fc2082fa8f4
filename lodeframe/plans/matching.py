"""Queries of joins, matching, clusters and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clustering as G
from ..operators import matching as M
from ..operators import search as S
from ..session import checkpointed
from .registry import Inputs, query

NEAR = "phash - phash % 4 + pk % 4"
CANDIDATES = "select e.pk, e.card_pk, e.set_code, e.number, e.border, e.artist, e.truncated, e.year, c.base_name as name from evidence e join cards c on c.pk = e.card_pk"


def near_hash() -> F.Column:
    return F.col("phash") - F.col("phash") % 4 + F.col("pk") % 4


def readings(i: Inputs) -> DataFrame:
    c = i.cards.select(F.col("pk").alias("card_pk"), F.col("base_name").alias("name"))
    return i.evidence.join(c, "card_pk")


@query("join_1_left_outer", "select s.pk, count(c.pk) as n from sources s left join cards c on c.source_pk = s.pk group by 1")
def _(i):
    c = i.cards.select(F.col("pk").alias("cpk"), F.col("source_pk").alias("pk"))
    return i.sources.select("pk").join(c, "pk", "left").groupBy("pk").agg(F.count("cpk").alias("n"))


@query("join_2_relation_paths", "select l_orderkey, l_linenumber, c_name, n_name, r_name, p_name, s_name from lineitem left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey")
def _(i):
    l = i.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = i.orders.select("o_orderkey", "o_custkey").join(i.customer.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    o = o.join(i.nation.select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(i.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    out = l.join(o, l.l_orderkey == o.o_orderkey, "left").join(i.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left").join(i.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name", "p_name", "s_name")


@query("join_3_semi", "select pk from cards where pk in (select card_pk from scans where reason in ('no-text', 'no-match'))")
def _(i):
    return i.cards.select("pk").join(i.scans.where(F.col("reason").isin("no-text", "no-match")).select(F.col("card_pk").alias("pk")), "pk", "left_semi")


@query("join_4_anti_same_row", "select pk from cards c where not exists (select 1 from scans s where s.card_pk = c.pk and s.engine = 'engine2' and s.run_id = 'run4')")
def _(i):
    return i.cards.select("pk").join(i.scans.where("engine = 'engine2' and run_id = 'run4'").select(F.col("card_pk").alias("pk")), "pk", "left_anti")


@query("join_5_two_exists", "select distinct entity, outcome from votes v where exists (select 1 from votes m where m.entity = v.entity and m.outcome = v.outcome and m.source in ('ocr', 'deduction')) and exists (select 1 from votes h where h.entity = v.entity and h.outcome = v.outcome and h.source in ('user', 'admin'))")
def _(i):
    machine, human = F.max(F.col("source").isin("ocr", "deduction")).alias("m"), F.max(F.col("source").isin("user", "admin")).alias("h")
    return i.votes.groupBy("entity", "outcome").agg(machine, human).where("m and h").select("entity", "outcome")


@query("join_6_latest_row", "select c.pk, (select s.reason from scans s where s.card_pk = c.pk order by ts desc, s.pk desc limit 1) as reason from cards c")
def _(i):
    last = i.scans.groupBy(F.col("card_pk").alias("pk")).agg(F.max_by("reason", F.struct("ts", "pk")).alias("reason"))
    return i.cards.select("pk").join(last, "pk", "left")


@query("join_7_tiered_names", "select pk, base_name as name, case pk % 3 when 0 then 0 when 1 then 1 else 2 end as tier from cards where base_name in (select name from printings)")
def _(i):
    r = F.col("pk") % 3
    glued = F.regexp_replace(F.initcap("base_name"), " ", "")
    rows = i.cards.select("pk", F.when(r == 0, F.col("base_name")).when(r == 1, F.concat("base_name", F.lit(" - Copy"))).otherwise(glued).alias("raw"))
    raw, name = F.col("raw"), F.col("name")
    suffix = T.without_copy_suffix(raw)
    glued_key = F.when(T.interior_capital(suffix), F.regexp_replace(T.searchable(suffix), " ", ""))
    tiers = [(T.searchable(raw), T.searchable(name)), (T.searchable(suffix), T.searchable(name)), (glued_key, F.regexp_replace(T.searchable(name), " ", ""))]
    return M.tiered_lookup(rows, "pk", tiers, i.printings, "name", (False, False, True))


@query("join_8_back_faces", "select c.pk, concat(p.front, ' // ', p.back) as name from cards c join (select distinct name as front, concat(reverse(name)) as back from printings) p on p.back = reverse(c.base_name)")
def _(i):
    pairs = i.printings.select(F.col("name").alias("front"), F.reverse("name").alias("back")).distinct()
    rows = i.cards.select("pk", F.reverse("base_name").alias("back"))
    return rows.join(pairs, "back").select("pk", F.concat("front", F.lit(" // "), "back").alias("name"))


@query("join_9_classified_matches", f"with e as ({CANDIDATES}), h as (select e.pk, count(*) as n, min(p.pk) as c from e join printings p on p.name = e.name and cast(cast(p.number as bigint) as string) = e.number and (e.set_code = '' or e.set_code = p.set_code) where e.number <> '' group by 1) select e.pk, case when n = 1 then c end as match, case when e.number = '' then 'no-text' when n is null then 'no-match' when n > 1 then 'ambiguous' else '' end as reason from e left join h on h.pk = e.pk")
def _(i):
    return M.classify_matches(readings(i), i.printings.select("pk", "name", "set_code", "number"), "pk", "name")


@query("join_10_hamming_pairs", f"with h as (select pk, {NEAR} as h from cards where phash is not null) , v as (select h, min(pk) as pk, count(*) as n from h group by 1) select least(a.pk, b.pk) as a, greatest(a.pk, b.pk) as b, cast(bit_count(xor(a.h, b.h)) as int) as distance, case when a.pk < b.pk then a.n else b.n end as n_a, case when a.pk < b.pk then b.n else a.n end as n_b from v a join v b on a.h < b.h and bit_count(xor(a.h, b.h)) <= 2 union all select pk, pk, 0, n, n from v where n > 1")
def _(i):
    """Pairs of groups of equal hashes by their smallest keys, with their sizes; a group of several is near itself."""
    pairs, groups = M.near_sized(i.cards.where("phash is not null").select("pk", near_hash().alias("h")), "pk", "h", 2)
    own = groups.where("n > 1").select(F.col("r").alias("a"), F.col("r").alias("b"), F.lit(0).alias("distance"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    return pairs.unionByName(own)


@query("join_11_probe_counts", f"with h as (select pk, {NEAR} as h from cards where phash is not null), p as (select distinct image_hash as h from printings) select count(*) filter (where d = 0) as exact, count(*) filter (where d <= 2) as near from (select pk, min(bit_count(xor(h.h, p.h))) as d from h join p on bit_count(xor(h.h, p.h)) <= 2 group by 1)")
def _(i):
    cards = i.cards.where("phash is not null").select("pk", near_hash().alias("h"))
    best = M.near_values(cards.select("h"), i.printings.select(F.col("image_hash").alias("h")), 2).groupBy(F.col("a").alias("h")).agg(F.min("distance").alias("d"))
    return cards.join(best, "h").agg(F.count_if(F.col("d") == 0).alias("exact"), F.count_if(F.col("d") <= 2).alias("near"))


WINNER = f"with h as (select pk, base_name, {NEAR} as h from cards where phash is not null), d as (select h.pk, p.pk as c, bit_count(xor(h.h, p.image_hash)) as d from h join printings p on p.name = h.base_name), r as (select *, row_number() over (partition by pk order by d, c) as rn, lead(d) over (partition by pk order by d, c) as nd from d) select pk, case when d <= 8 and (nd is null or nd - d > 2) then c end as winner, cast(d as int) as best, case when d > 8 then 'distance-miss' when nd is not null and nd - d <= 2 then 'margin-miss' else '' end as reason from r where rn = 1"


def distances(i: Inputs) -> DataFrame:
    cards = i.cards.where("phash is not null").select("pk", F.col("base_name").alias("name"), near_hash().alias("h"))
    p = i.printings.select(F.col("pk").alias("c"), "name", "image_hash", "set_code")
    return cards.join(p, "name").select("pk", "c", "set_code", M.hamming(F.col("h"), F.col("image_hash")).alias("d"))


@query("join_12_clear_winner", WINNER)
def _(i):
    return M.clear_winner(distances(i), "pk", "c", "d", 8, 2)


@query("join_13_why_no_winner", f"select reason, count(*) as n from ({WINNER}) group by 1")
def _(i):
    return M.clear_winner(distances(i), "pk", "c", "d", 8, 2).groupBy("reason").agg(F.count("*").alias("n"))


@query("win_4_best_and_second", f"with h as (select pk, base_name, {NEAR} as h from cards where phash is not null), d as (select h.pk, p.pk as c, cast(bit_count(xor(h.h, p.image_hash)) as int) as d from h join printings p on p.name = h.base_name) select pk, d as best, nd as second from (select pk, d, lead(d) over (partition by pk order by d, c) as nd, row_number() over (partition by pk order by d, c) as rn from d) where rn = 1")
def _(i):
    two = S.newest(distances(i), ["pk"], [F.col("d"), F.col("c")], 2).groupBy("pk").agg(F.min("d").alias("best"), F.max("d").alias("m"), F.count("*").alias("n"))
    return two.select("pk", "best", F.when(F.col("n") > 1, F.col("m")).alias("second"))


@query("win_5_set_tie_break", f"with h as (select pk, base_name, {NEAR} as h from cards where phash is not null), d as (select h.pk, p.set_code as c, min(cast(bit_count(xor(h.h, p.image_hash)) as int)) as d from h join printings p on p.name = h.base_name group by 1, 2), r as (select *, row_number() over (partition by pk order by d, c) as rn, lead(d) over (partition by pk order by d, c) as nd from d) select pk, case when d <= 6 and (nd is null or nd - d > 6) then c end as winner, d as best, case when d > 6 then 'distance-miss' when nd is not null and nd - d <= 6 then 'margin-miss' else '' end as reason from r where rn = 1")
def _(i):
    one = distances(i).groupBy("pk", "set_code").agg(F.min("d").alias("d"))
    return M.clear_winner(one, "pk", "set_code", "d", 6, 6)


@query("join_14_nearest_first", f"with h as (select pk, {NEAR} as h from cards where phash is not null) select h.pk, coalesce(array_to_string(list(p.pk order by bit_count(xor(h.h, p.image_hash)), p.pk) filter (where p.pk is not null), ','), '') as matches from h left join printings p on bit_count(xor(h.h, p.image_hash)) <= 2 group by 1")
def _(i):
    cards = i.cards.where("phash is not null").select("pk", near_hash().alias("h"))
    near = M.near_values(cards.select("h"), i.printings.select(F.col("image_hash").alias("h")), 2)
    hits = near.join(i.printings.select(F.col("pk").alias("p"), F.col("image_hash").alias("b")), "b").groupBy(F.col("a").alias("h")).agg(F.array_sort(F.collect_list(F.struct("distance", "p"))).alias("m"))
    return cards.join(hits, "h", "left").select("pk", F.coalesce(F.array_join(F.transform("m", lambda x: x["p"].cast("string")), ","), F.lit("")).alias("matches"))


IDENTITY = "select distinct a.pk, b.pk as member from cards a join cards b on a.pk = b.pk or (a.md5 is not null and a.md5 <> '' and a.md5 = b.md5) or (a.phash is not null and a.phash = b.phash)"


@query("join_15_identity_groups", IDENTITY.replace("select distinct a.pk, b.pk as member", "select a.pk, count(distinct b.pk) as n, min(b.pk) as least") + " group by 1")
def _(i):
    return M.identity_groups(i.cards.select("pk", "md5", "phash"), "pk", "md5", "phash")


@query("join_16_group_broadcast", "with g as (select case when md5 is null or md5 = '' then cast(pk as string) else md5 end as k, max(canonical_pk) as v from cards group by 1) select pk, v as canonical_pk from cards join g on k = case when md5 is null or md5 = '' then cast(pk as string) else md5 end")
def _(i):
    grouped = M.group_key(i.cards.select("pk", "md5", "canonical_pk"), "pk", "md5")
    best = grouped.groupBy("group").agg(F.max("canonical_pk").alias("v"))
    return grouped.join(best, "group").select("pk", F.col("v").alias("canonical_pk"))


@query("join_17_propagated", "with s as (select phash, min(pk) as source from cards where phash is not null and canonical_pk is not null group by 1) select c.pk, k.canonical_pk, s.source from cards c join s using (phash) join cards k on k.pk = s.source where c.canonical_pk is null and c.pk not in (select entity from votes where outcome = 'view' and source = 'admin')")
def _(i):
    voted = i.votes.where("outcome = 'view' and source = 'admin'").select(F.col("entity").alias("pk"))
    return M.propagated(i.cards.select("pk", "phash", "canonical_pk"), "pk", "phash", "canonical_pk", voted)


@query("join_18_evidence_transfer", "with s as (select md5, min(pk) as source, min(phash) as h from cards where md5 is not null and md5 <> '' and created_day > 180 group by 1) select c.pk, s.source, case when c.phash is null or s.h is null or c.phash = s.h then 'transfer' else 'anomaly' end as action from cards c join s using (md5) where c.created_day <= 180")
def _(i):
    known = F.col("md5").isNotNull() & (F.col("md5") != "")
    s = i.cards.where(known & (F.col("created_day") > 180)).groupBy("md5").agg(F.min("pk").alias("source"), F.min("phash").alias("h"))
    agrees = F.col("phash").isNull() | F.col("h").isNull() | (F.col("phash") == F.col("h"))
    return i.cards.where(known & (F.col("created_day") <= 180)).join(s, "md5").select("pk", "source", F.when(agrees, "transfer").otherwise("anomaly").alias("action"))


@query("join_19_verdict_partition", "select pk, md5 in (select md5 from cards where status = 'RESOLVED' and md5 <> '' and md5 is not null) as decided from cards where md5 <> '' and md5 is not null and status <> 'RESOLVED'")
def _(i):
    c = i.cards.where("md5 <> '' and md5 is not null")
    done, batch = c.where("status = 'RESOLVED'").select("md5").distinct(), c.where("status <> 'RESOLVED'").select("pk", "md5")
    return batch.join(done, "md5", "left_semi").withColumn("decided", F.lit(True)).unionByName(batch.join(done, "md5", "left_anti").withColumn("decided", F.lit(False))).select("pk", "decided")


SURVIVORS = f"""with e as ({CANDIDATES}), p as (select e.pk, border <> '' or artist <> '' as any_reading, border <> '' and artist <> '' as two,
    (select count(*) from printings q where q.name = e.name and (e.border = '' or q.border = e.border) and (e.artist = '' or q.artist = e.artist)) as n,
    (select min(q.pk) from printings q where q.name = e.name and (e.border = '' or q.border = e.border) and (e.artist = '' or q.artist = e.artist)) as c
    from e where name in (select name from printings))"""


def survivors(i: Inputs) -> DataFrame:
    """(pk, n, match, n_read): readings and how many printings of their name survive border and artist."""
    return M.surviving_counts(readings(i).select("pk", "name", "border", "artist"), "pk", "name", i.printings, "pk", ["border", "artist"])


@query("join_20_survivors", f"{SURVIVORS} select pk, case when not any_reading then null else n end as n, case when any_reading and n = 1 then c end as match from p")
def _(i):
    return survivors(i).select("pk", "n", "match")


@query("join_21_artwork_index", "select name, artist, case when count(distinct illustration) = 1 and count(*) = 1 then min(pk) end as printing_pk, count(distinct illustration) as artworks, count(*) as printings from printings group by 1, 2")
def _(i):
    p = i.printings.groupBy("name", "artist").agg(F.countDistinct("illustration").alias("artworks"), F.count("*").alias("printings"), F.min("pk").alias("p"))
    return p.select("name", "artist", F.when((F.col("artworks") == 1) & (F.col("printings") == 1), F.col("p")).alias("printing_pk"), "artworks", "printings")


@query("join_22_unique_prefix", "with t as (select pk, substr(base_name, 1, 5 + cast(pk % 6 as int)) as t from cards), n as (select distinct name from printings), m as (select t.pk, count(*) as m, min(name) as lo, max(case when name = t then name end) as exact from t join n on starts_with(name, t) group by 1) select pk, coalesce(exact, case when m = 1 then lo end) as name from m where exact is not null or m = 1")
def _(i):
    rows = i.cards.select("pk", F.expr("substr(base_name, 1, 5 + cast(pk % 6 as int))").alias("t"))
    return M.unique_prefix(rows, "pk", "t", i.printings, "name")


@query("join_22_short_prefixes", "with t as (select pk, substr(base_name, 1, 1 + cast(pk % 9 as int)) as t from cards), n as (select distinct name from printings), m as (select t.pk, count(*) as m, min(name) as lo, max(case when name = t then name end) as exact from t join n on starts_with(name, t) group by 1) select pk, coalesce(exact, case when m = 1 then lo end) as name from m where exact is not null or m = 1")
def _(i):
    """Texts of one to nine letters."""
    rows = i.cards.select("pk", F.expr("substr(base_name, 1, 1 + cast(pk % 9 as int))").alias("t"))
    return M.unique_prefix(rows, "pk", "t", i.printings, "name")


@query("agg_29_unique_candidate", "select c.pk, min(p.pk) as printing_pk from cards c join printings p on p.name = c.base_name and p.set_code = c.expansion_hint group by 1 having count(*) = 1")
def _(i):
    p = i.printings.select(F.col("pk").alias("p"), F.col("name").alias("base_name"), F.col("set_code").alias("expansion_hint"))
    return i.cards.select("pk", "base_name", "expansion_hint").join(p, ["base_name", "expansion_hint"]).groupBy("pk").agg(F.min("p").alias("printing_pk"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("agg_30_one_to_one", "with p as (select name, set_code, min(pk) as printing_pk from printings group by 1, 2 having count(*) = 1), o as (select base_name, expansion_hint, min(pk) as pk from cards where status <> 'RESOLVED' and expansion_hint <> '' group by 1, 2 having count(*) = 1) select pk, printing_pk from p join o on base_name = name and expansion_hint = set_code")
def _(i):
    p = i.printings.groupBy(F.col("name").alias("base_name"), F.col("set_code").alias("expansion_hint")).agg(F.min("pk").alias("printing_pk"), F.count("*").alias("n")).where("n = 1")
    o = i.cards.where("status <> 'RESOLVED' and expansion_hint <> ''").groupBy("base_name", "expansion_hint").agg(F.min("pk").alias("pk"), F.count("*").alias("m")).where("m = 1")
    return p.join(o, ["base_name", "expansion_hint"]).select("pk", "printing_pk")


@query("set_5_widened_keys", f"with l as ({IDENTITY}) select distinct member as pk from l where pk in (select entity from votes where agent = 'user8')")
def _(i):
    return M.widened(i.cards.select("pk", "md5", "phash"), "pk", ["md5", "phash"], i.votes.where("agent = 'user8'").select(F.col("entity").alias("pk")))


@query("set_6_voter_exclusion", "select pk from cards where md5 is null or md5 not in (select md5 from cards where md5 is not null and md5 <> '' and pk in (select entity from votes where agent = 'user8'))")
def _(i):
    done = i.votes.where("agent = 'user8'").select(F.col("entity").alias("pk")).distinct()
    keys = i.cards.where("md5 is not null and md5 <> ''").join(done, "pk", "left_semi").select("md5").distinct()
    return i.cards.select("pk", "md5").join(keys, "md5", "left_anti").select("pk")


@query("grf_1_exact_clusters", "select phash, min(pk) as representative, count(*) as n from cards where phash is not null group by 1 having count(*) > 1")
def _(i):
    return G.exact_clusters(i.cards, "pk", "phash")


@query("grf_2_two_thresholds", f"with h as (select pk, {NEAR} as h from cards where phash is not null), v as (select distinct h from h) select 'same' as tier, cast(count(*) as bigint) as n from (select h from h group by 1 having count(*) > 1) union all select 'near', count(*) from v a join v b on a.h < b.h and bit_count(xor(a.h, b.h)) <= 2")
def _(i):
    rows = i.cards.where("phash is not null").select("pk", near_hash().alias("h"))
    same = G.exact_clusters(rows, "pk", "h").agg(F.count("*").alias("n")).select(F.lit("same").alias("tier"), "n")
    near = M.near_values(rows.select("h"), rows.select("h"), 2).where("a < b").agg(F.count("*").alias("n")).select(F.lit("near").alias("tier"), "n")
    return same.unionByName(near)


@query("grf_3_components", "with recursive e as (select a.pk as a, b.pk as b from cards a join cards b on (a.phash = b.phash or (a.md5 = b.md5 and a.md5 <> ''))), r as (select distinct a as pk, a as c from e union select r.pk, e.b from r join e on e.a = r.c) select c.pk, coalesce(min(r.c), c.pk) as component from cards c left join r on r.pk = c.pk group by c.pk")
def _(i):
    nodes = i.cards.select("pk", "phash", "md5")
    edges = G.shared_value_edges(nodes, "pk", [F.col("phash"), F.nullif("md5", F.lit(""))])
    return G.components(nodes, edges, "pk", checkpointed)


SIGNALS = "select identifier, case when pk % 4 <> 0 then phash end as picture, case when pk % 3 = 0 and md5 <> '' then md5 end as symbol, case when pk % 5 = 0 then concat('line ', cast(cast(floor(pk / 35) as bigint) as string)) end as small_print from cards"
CLUSTERS = f"""with recursive g as materialized ({SIGNALS}), v as (select identifier as i, concat('p', cast(picture as string)) as v from g where picture is not null union all select identifier, concat('s', symbol) from g where symbol is not null union all select identifier, concat('t', small_print) from g where small_print is not null),
    e as materialized (select i as b, min(i) over (partition by v) as a from v), n as materialized (select a, b from e union select b, a from e), r as (select i, i as c from (select distinct i from v) union select n.b, r.c from r join n on n.a = r.i),
    c as materialized (select i, min(c) as cluster from r group by 1), z as (select cluster, count(*) as size from c group by 1 having count(*) > 1),
    m as (select c.cluster, substr(v, 1, 1) as kind, v from c join v using (i) join z using (cluster) group by 1, 2, 3 having count(*) > 1)"""


@query("grf_3_review_clusters", f"{CLUSTERS} select cluster, size, count(m.v) filter (kind = 'p') as picture, count(m.v) filter (kind = 's') as symbol, count(m.v) filter (kind = 't') as small_print from z left join m using (cluster) group by 1, 2")
def _(i):
    """Clusters over three signals and textual keys."""
    signals = {"picture": F.when(F.col("pk") % 4 != 0, F.col("phash")), "symbol": F.when((F.col("pk") % 3 == 0) & (F.col("md5") != ""), F.col("md5")), "small_print": F.when(F.col("pk") % 5 == 0, F.concat(F.lit("line "), F.floor(F.col("pk") / 35).cast("string")))}
    return G.review_clusters(i.cards, "identifier", signals)[1]


@query("grf_4_ancestors", "with recursive up as (select pk, pk as ancestor from tags union all select up.pk, t.parent_pk from up join tags t on t.pk = up.ancestor where t.parent_pk is not null) select pk, ancestor from up")
def _(i):
    return G.ancestors(i.tags, "pk", "parent_pk")


@query("src_8_inherited_attributes", "with recursive up as (select pk, pk as ancestor, 0 as depth from tags union all select up.pk, t.parent_pk, depth + 1 from up join tags t on t.pk = up.ancestor where t.parent_pk is not null) select up.pk, min_by(concat('lang', cast(up.ancestor % 3 as string)), case when up.ancestor % 5 = 0 then depth end) as language, count(*) as n_path from up group by 1")
def _(i):
    up = G.ancestors(i.tags, "pk", "parent_pk")
    depth = up.groupBy("pk").agg(F.count("*").alias("n"))
    withd = up.join(depth.select(F.col("pk").alias("ancestor"), F.col("n").alias("level")), "ancestor")
    own = F.when(F.col("ancestor") % 5 == 0, F.col("level"))
    return withd.groupBy("pk").agg(F.max_by(F.concat(F.lit("lang"), (F.col("ancestor") % 3).cast("string")), own).alias("language"), F.count("*").alias("n_path"))


@query("grf_5_cluster_lookup", "select c.pk from cards c where phash = (select phash from cards where pk = 30)")
def _(i):
    g = M.group_key(i.cards.where("phash is not null").select("pk", "phash"), "pk", "phash")
    one = g.where("pk = 30").select("group")
    return g.join(F.broadcast(one), "group", "left_semi").select("pk")


@query("img_2_signed_hashes", "select vec_id, cast(vec_id * 37 - 5000 as bigint) as h from embeddings")
def _(i):
    unsigned = F.hex(F.col("vec_id") * 37 - 5000)
    high = F.conv(F.substring(F.lpad(unsigned, 16, "0"), 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(F.lpad(unsigned, 16, "0"), 9, 8), 16, 10).cast("long")
    return i.embeddings.select("vec_id", F.shiftleft(high, 32).bitwiseOR(low).alias("h"))


@query("img_3_hamming", "select a.vec_id, cast(bit_count(xor(a.vec_id * 37 - 5000, 7 - a.vec_id)) as int) as d from embeddings a")
def _(i):
    return i.embeddings.select("vec_id", M.hamming(F.col("vec_id") * 37 - 5000, 7 - F.col("vec_id")).alias("d"))


@query("img_1_sign_hash", "select vec_id, cast(list_sum(list_transform(embedding[1:63], lambda x, i: case when x > 0 then (cast(1 as bigint) << cast(i - 1 as bigint)) else 0 end)) as bigint) + case when embedding[64] > 0 then -9223372036854775808 else 0 end as h from embeddings")
def _(i):
    one = F.lit(1).cast("long")
    bits = F.transform(F.slice("embedding", 1, 64), lambda x, k: F.when(x > 0, F.call_function("shiftleft", one, k)).otherwise(F.lit(0).cast("long")))
    return i.embeddings.select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias("h"))


@query("img_5_bleed_class", "select pk, case when inset_a / (inset_b + 10) > 1.5 then 'bleed' when inset_a / (inset_b + 10) > 0.8 then 'trimmed' else 'unknown' end as class from evidence")
def _(i):
    r = F.col("inset_a") / (F.col("inset_b") + 10)
    return i.evidence.select("pk", F.when(r > 1.5, "bleed").when(r > 0.8, "trimmed").otherwise("unknown").alias("class"))


@query("img_6_crop_boxes", "select pk, round((inset_a / 100 - 0.036) / (1 - 2 * 0.036), 6) as x0, round((inset_a / 100 + 0.2 - 0.036) / (1 - 2 * 0.036), 6) as x1 from evidence")
def _(i):
    scale = lambda c: F.round((c - 0.036) / (1 - 2 * 0.036), 6)
    return i.evidence.select("pk", scale(F.col("inset_a") / 100).alias("x0"), scale(F.col("inset_a") / 100 + 0.2).alias("x1"))


@query("img_7_edge_distance", "select pk, sqrt(power(inset_a - 10, 2) + power(inset_b - 20, 2) + power(content_hash - 25, 2)) <= 30 or sqrt(power(inset_a - 40, 2) + power(inset_b - 5, 2) + power(content_hash, 2)) <= 30 as continues from evidence")
def _(i):
    d = lambda a, b, c: F.sqrt(F.pow(F.col("inset_a") - a, 2) + F.pow(F.col("inset_b") - b, 2) + F.pow(F.col("content_hash") - c, 2))
    return i.evidence.select("pk", ((d(10, 20, 25) <= 30) | (d(40, 5, 0) <= 30)).alias("continues"))
