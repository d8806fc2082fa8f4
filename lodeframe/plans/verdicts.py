"""Queries of verdict cascades, batch drivers and serving policies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.similarity import indel_similarity
from ..operators import consensus as C
from ..operators import matching as M
from ..operators import runs as R
from ..operators import search as S
from ..operators import serving as Q
from ..operators import verdicts as V
from ..session import checkpointed, shared_folder
from .consensus import WEIGHED, consensus_sql, weighed
from .matching import CANDIDATES, SURVIVORS, readings, survivors
from .registry import Inputs, query

KNOWN = ["s0", "s1", "s2", "s3", "s4", "s5", "s6", "s7", "s8"]
MATCHED = f"with e as ({CANDIDATES}), h as (select e.pk, e.set_code, e.number, count(*) as n, min(p.pk) as c from (select distinct pk, name, set_code, number from e) e join printings p on p.name = e.name and cast(cast(p.number as bigint) as string) = e.number and (e.set_code = '' or e.set_code = p.set_code) where e.number <> '' group by 1, 2, 3), m as (select distinct e.pk, e.set_code, e.number, case when n = 1 then c end as match, case when e.number = '' then 'no-text' when n is null then 'no-match' when n > 1 then 'ambiguous' else '' end as reason from e left join h on h.pk = e.pk and h.set_code = e.set_code and h.number = e.number)"


def one_reading(i: Inputs) -> DataFrame:
    """One reading for each row: the newest, then by all that was read."""
    order = F.struct("updated_at", "score", "set_code", "number", "border", "artist", "pk")
    e = i.evidence
    rest = [c for c in e.columns if c != "card_pk"]
    last = e.groupBy("card_pk").agg(F.max_by(F.struct(*rest), order).alias("r")).select("card_pk", "r.*")
    return last.join(i.cards.select(F.col("pk").alias("card_pk"), F.col("base_name").alias("name")), "card_pk")


LAST = "l as (select * from (select e.*, c.base_name as name, row_number() over (partition by card_pk order by updated_at desc, score desc, set_code desc, number desc, e.border desc, e.artist desc, e.pk desc) as rn from evidence e join cards c on c.pk = e.card_pk) where rn = 1)"
JUDGED = f"{LAST}, h as (select card_pk, count(*) as n, min(p.pk) as c from l join printings p on p.name = l.name and cast(cast(p.number as bigint) as string) = l.number and (l.set_code = '' or l.set_code = p.set_code) where l.number <> '' group by 1), j as (select l.*, case when n = 1 then c end as match, case when l.number = '' then 'no-text' when n is null then 'no-match' when n > 1 then 'ambiguous' else '' end as reason from l left join h using (card_pk)), v as (select card_pk, case when match is not null then cast(match as string) when reason = 'no-match' and not (set_code <> '' and set_code not in ('s0', 's1', 's2', 's3', 's4', 's5', 's6', 's7', 's8')) then 'NO_MATCH' end as outcome, case when match is not null then case when set_code <> '' then 0.85 else 0.75 end when reason = 'no-match' and not (set_code <> '' and set_code not in ('s0', 's1', 's2', 's3', 's4', 's5', 's6', 's7', 's8')) then 0.6 end as confidence, case when match is not null then '' when reason = 'no-match' then case when set_code <> '' and set_code not in ('s0', 's1', 's2', 's3', 's4', 's5', 's6', 's7', 's8') then 'unknown-set-code' else '' end else reason end as skip_reason from j)"


def judged(i: Inputs, numbers: int | None = None) -> DataFrame:
    """Verdicts by set and number; with ``numbers``, collector numbers count by their rest only, so several printings of a name have one."""
    rest = lambda df: df.withColumn("number", F.coalesce((F.expr("try_cast(number as bigint)") % numbers).cast("string"), "number")) if numbers else df
    rows = rest(one_reading(i))
    found = M.classify_matches(rows, rest(i.printings.select("pk", "name", "set_code", "number")), "card_pk", "name")
    joined = rows.join(found, "card_pk")
    return joined.withColumn("v", V.join_key_verdict(F.col("match"), F.col("reason"), F.col("set_code"), KNOWN))


@query("ver_1_join_key", f"with {JUDGED} select card_pk, outcome, cast(confidence as double) as confidence, skip_reason from v")
def _(i):
    return judged(i).select("card_pk", "v.*")


AGREED = f"with {JUDGED}, a as (select j.card_pk, case when truncated then 'truncated' when p.released_year - j.year > 2 then 'year-before-release' when j.artist <> '' and p.artist <> '' and lower(j.artist) <> lower(p.artist) then 'artist-mismatch' else '' end as skip_reason, v.confidence, j.border <> '' and j.border <> p.border as weak from j join v using (card_pk) join printings p on p.pk = j.match)"


@query("ver_2_agreement", f"{AGREED} select card_pk, skip_reason, cast(case when skip_reason = '' then case when weak then least(confidence, 0.65) else confidence end end as double) as confidence from a")
def _(i):
    p = i.printings.select(F.col("pk").alias("match"), F.col("artist").alias("ka"), F.col("border").alias("kb"), "released_year")
    a = V.agreement(F.col("v.confidence"), F.col("truncated"), F.col("year"), F.col("released_year"), F.col("artist"), F.col("ka"), F.col("border"), F.col("kb"))
    return judged(i).join(p, "match").select("card_pk", a.alias("a")).select("card_pk", "a.*")


@query("ver_3_disagreement", f"with e as ({CANDIDATES}) select e.pk, count(*) filter (where e.border <> '' and e.border <> p.border) as n from e join printings p on p.name = e.name group by 1")
def _(i):
    p = i.printings.select("name", F.col("border").alias("kb"))
    return readings(i).join(p, "name").groupBy("pk").agg(F.count_if(V.disagreement(F.col("border"), F.col("kb"))).alias("n"))


FALLBACK = f"{SURVIVORS} select pk, case when any_reading and n = 1 then cast(c as string) end as outcome, case when any_reading and n = 1 then cast(case when two then 0.8 else 0.7 end as double) end as confidence, case when not any_reading then 'no-reading' when n = 0 then 'no-survivor' when n = 1 then '' else 'ambiguous' end as skip_reason from p"


@query("ver_4_fallback", FALLBACK)
def _(i):
    return survivors(i).select("pk", V.counted_verdict(F.col("n"), F.col("match"), F.col("n_read")).alias("v")).select("pk", "v.*")


@query("ver_5_slow_path", "select pk, 'slow-path' as route from cards where pk not in (select entity from votes where entity is not null and source = 'ocr') and pk not in (select card_pk from scans where reason = '')")
def _(i):
    one, two = i.votes.where("source = 'ocr'").select(F.col("entity").alias("pk")), i.scans.where("reason = ''").select(F.col("card_pk").alias("pk"))
    return V.unresolved(i.cards.select("pk"), "pk", one, two).withColumn("route", F.lit("slow-path"))


@query("ver_6_artwork_rule", "with a as (select name, artist, count(distinct illustration) as arts, count(*) as n, min(pk) as p from printings group by 1, 2) select c.pk, case when arts = 1 and n = 1 then p end as printing_pk, case when arts is null then 'no-artwork' when arts > 1 then 'many-artworks' when n > 1 then 'many-printings' else '' end as skip_reason from cards c left join a on a.name = c.base_name and a.artist = c.card_type")
def _(i):
    a = i.printings.groupBy(F.col("name").alias("base_name"), F.col("artist").alias("card_type")).agg(F.countDistinct("illustration").alias("arts"), F.count("*").alias("n"), F.min("pk").alias("p"))
    skip = F.when(F.col("arts").isNull(), "no-artwork").when(F.col("arts") > 1, "many-artworks").when(F.col("n") > 1, "many-printings").otherwise("")
    return i.cards.select("pk", "base_name", "card_type").join(a, ["base_name", "card_type"], "left").select("pk", F.when(skip == "", F.col("p")).alias("printing_pk"), skip.alias("skip_reason"))


@query("ver_7_artist_then_hash", "with d as (select c.pk, p.pk as p, bit_count(xor(c.phash, p.image_hash)) as d from cards c join printings p on p.name = c.base_name and p.artist = 'PROMO' where c.phash is not null), r as (select *, count(*) over (partition by pk) as n, row_number() over (partition by pk order by d, p) as rn, lead(d) over (partition by pk order by d, p) as nd from d) select pk, case when n = 1 or (d <= 20 and nd - d > 2) then p end as printing_pk, cast(case when n = 1 then 0.85 when d <= 20 and nd - d > 2 then 0.8 end as double) as confidence from r where rn = 1")
def _(i):
    p = i.printings.where("artist = 'PROMO'").select(F.col("pk").alias("p"), F.col("name").alias("base_name"), "image_hash")
    pairs = i.cards.where("phash is not null").join(p, "base_name").select("pk", "p", M.hamming(F.col("phash"), F.col("image_hash")).alias("d"))
    n = pairs.groupBy("pk").agg(F.count("*").alias("n"), F.min("p").alias("only"))
    best = M.clear_winner(pairs, "pk", "p", "d", 20, 2).join(n, "pk")
    alone = F.col("n") == 1
    return best.select("pk", F.when(alone, F.col("only")).otherwise(F.col("winner")).alias("printing_pk"), F.when(alone, 0.85).when(F.col("winner").isNotNull(), 0.8).cast("double").alias("confidence"))


@query("ver_8_class_tags", "select pk, case layout when 'transform' then 'Double Faced' when 'split' then 'Split' end as tag, case when layout in ('transform', 'split') then '' else 'unmapped' end as skip_reason from printings")
def _(i):
    return i.printings.select("pk", V.mapped(F.col("layout"), {"transform": "Double Faced", "split": "Split"}).alias("m")).select("pk", "m.*")


@query("ver_9_two_methods", "select pk, round(case when abs(inset_a - inset_b) <= 2 then (inset_a + inset_b) / 2 end, 6) as bleed from evidence")
def _(i):
    return i.evidence.select("pk", F.round(V.two_methods(F.col("inset_a"), F.col("inset_b"), 2.0), 6).alias("bleed"))


@query("ver_10_never_empty", "with g as (select name, list(pk) filter (where border = 'borderless' and full_art) as narrow, list(pk) as every from printings group by 1) select name, len(case when narrow is null or len(narrow) = 0 then every else narrow end) as n from g")
def _(i):
    narrow = F.count_if((F.col("border") == "borderless") & F.col("full_art"))
    g = i.printings.groupBy("name").agg(narrow.alias("narrow"), F.count("*").alias("every"))
    return g.select("name", F.when(F.col("narrow") > 0, F.col("narrow")).otherwise(F.col("every")).alias("n"))


@query("ver_12_recovered_vetoes", f"{AGREED} select card_pk from a where skip_reason = 'artist-mismatch' and not weak")
def _(i):
    p = i.printings.select(F.col("pk").alias("match"), F.col("artist").alias("ka"), F.col("border").alias("kb"), "released_year")
    a = V.agreement(F.col("v.confidence"), F.col("truncated"), F.col("year"), F.col("released_year"), F.col("artist"), F.col("ka"), F.col("border"), F.col("kb"))
    return judged(i).join(p, "match").where((a["skip_reason"] == "artist-mismatch") & ~V.disagreement(F.col("border"), F.col("kb"))).select("card_pk")


OLD = "select entity, max(outcome) as value from votes where ts < timestamp '2024-01-20 00:00:00' group by 1"
NEW = "select entity, max(outcome) as value from votes where ts >= timestamp '2024-01-10 00:00:00' group by 1"


@query("ver_13_rejudged", f"with b as ({OLD}), a as ({NEW}) select coalesce(b.entity, a.entity) as entity, b.value as before, a.value as after, case when b.entity is null then 'added' when a.entity is null then 'removed' when b.value = a.value then 'same' else 'changed' end as change from b full join a on a.entity = b.entity")
def _(i):
    old = i.votes.where("ts < '2024-01-20'").groupBy("entity").agg(F.max("outcome").alias("value"))
    new = i.votes.where("ts >= '2024-01-10'").groupBy("entity").agg(F.max("outcome").alias("value"))
    return V.compared(old, new, "entity", "value")


@query("drv_4_calculator_counts", f"with {JUDGED} select skip_reason, count(*) as n from v group by 1")
def _(i):
    return V.split_outcomes(judged(i))[2]


@query("drv_5_tag_caster", "select case layout when 'transform' then 'Double Faced' when 'split' then 'Split' else 'skipped' end as tag, count(*) as n from printings group by 1")
def _(i):
    m = V.mapped(F.col("layout"), {"transform": "Double Faced", "split": "Split"})
    return i.printings.groupBy(F.coalesce(m["tag"], F.lit("skipped")).alias("tag")).agg(F.count("*").alias("n"))


@query("drv_6_multi_engine", f"with {JUDGED}, f as (select card_pk, outcome from v) select count(*) as n, count(outcome) as n_cast from f")
def _(i):
    return judged(i).agg(F.count("*").alias("n"), F.count("v.outcome").alias("n_cast"))


@query("drv_7_deductive_run", f"with d as (select c.pk as entity, cast(min(p.pk) as string) as outcome from cards c join printings p on p.name = c.base_name and p.set_code = c.expansion_hint group by 1 having count(*) = 1), votes_of as (select entity, outcome, 0.5 as weight, false as human, false as implicit, false as privileged from d), {consensus_sql('votes_of')} select (select count(*) from d) as n_cast, count(resolved) as n_resolved from final")
def _(i):
    p = i.printings.select(F.col("pk").alias("p"), F.col("name").alias("base_name"), F.col("set_code").alias("expansion_hint"))
    d = i.cards.select("pk", "base_name", "expansion_hint").join(p, ["base_name", "expansion_hint"]).groupBy(F.col("pk").alias("entity")).agg(F.min("p").alias("p"), F.count("*").alias("n")).where("n = 1")
    v = d.select("entity", F.col("p").cast("string").alias("outcome"), F.lit(0.5).alias("weight"), *[F.lit(False).alias(k) for k in ("human", "implicit", "privileged")])
    return C.consensus(v).agg(F.count("*").alias("n_cast"), F.count("resolved").alias("n_resolved"))


LANES = "select agent, entity, case when outcome = 'purchase' then 0 when outcome = 'click' then 1 else 2 end as lane, case when source = 'ocr' then 0 else 1 end as kind, value, pk from votes where agent is not null"


@query("drv_9_next_question", f"with l as ({LANES}) select agent, entity, lane from (select *, row_number() over (partition by agent order by lane, kind, value desc, pk) as rn from l) where rn = 1")
def _(i):
    lane = F.when(F.col("outcome") == "purchase", 0).when(F.col("outcome") == "click", 1).otherwise(2)
    l = i.votes.where("agent is not null").withColumn("lane", lane).withColumn("kind", F.when(F.col("source") == "ocr", 0).otherwise(1))
    best = F.min_by(F.struct("entity", "lane"), F.struct("lane", "kind", (-F.col("value")).alias("v"), "pk"))
    return l.groupBy("agent").agg(best.alias("b")).select("agent", "b.*")


POOL = """select * from (select pk as card, lane, row_number() over (partition by lane order by priority desc, pk) as place from (select pk, priority, case when status = 'UNRESOLVED' and pk % 2 = 0 then 'likely' when inferred_pk is not null then 'confirm' when status = 'CONTESTED' then 'contested' else 'fresh' end as lane from cards)) where place <= 40"""
SERVED_LOG = "select agent as voter, case when outcome = 'purchase' or outcome = 'error' then 'likely' else 'fresh' end as lane from votes where agent is not null and pk % 5 = 0"


@query(
    "drv_9_served_mix",
    f"""with recursive pool as ({POOL}), seen as (select distinct agent as voter, entity as card from votes where agent is not null), voters as (select distinct voter from seen),
    open as (select voter, lane, card, row_number() over (partition by voter, lane order by place) as k from voters, pool where not exists (select 1 from seen where seen.voter = voters.voter and seen.card = pool.card)),
    left_ as (select voter, count(*) filter (lane = 'likely') as l, count(*) filter (lane = 'confirm') as c, count(*) filter (lane = 'contested') as x, count(*) filter (lane = 'fresh') as f from open group by 1),
    log_ as (select voter, count(*) as total, count(*) filter (lane = 'likely') as likely from ({SERVED_LOG}) group by 1),
    d as (select voter, 0 as draw, coalesce(total, 0) as total, coalesce(likely, 0) as likely, 0 as nl, 0 as nc, 0 as nx, 0 as nf, cast(null as varchar) as lane, cast(0 as bigint) as k, cast(0 as double) as share from voters left join log_ using (voter)
        union all select voter, draw + 1, total + 1, likely + (case when pick = 'likely' then 1 else 0 end), nl + (case when pick = 'likely' then 1 else 0 end), nc + (case when pick = 'confirm' then 1 else 0 end), nx + (case when pick = 'contested' then 1 else 0 end), nf + (case when pick = 'fresh' then 1 else 0 end), pick,
            1 + (case pick when 'likely' then nl when 'confirm' then nc when 'contested' then nx else nf end), now_
        from (select d.*, now_, case when now_ < 0.51 and nl < left_.l then 'likely' when nc < left_.c then 'confirm' when nx < left_.x then 'contested' when nf < left_.f then 'fresh' end as pick from (select *, case when total > 0 then likely / total else 0 end as now_ from d) d join left_ using (voter)) where draw < 60 and pick is not null)
    select voter, draw, lane, card, share from d join open using (voter, lane, k) where draw > 0""",
)
def _(i):
    """Sixty draws a voter from four pools of 40 cards, until these run out for them."""
    lane = F.when((F.col("status") == "UNRESOLVED") & (F.col("pk") % 2 == 0), "likely").when(F.col("inferred_pk").isNotNull(), "confirm").when(F.col("status") == "CONTESTED", "contested").otherwise("fresh")
    pool = checkpointed(Q.pooled(i.cards.withColumn("lane", lane), "pk", "lane", [F.desc("priority"), "pk"], 40))
    votes = i.votes.where("agent is not null").select(F.col("agent").alias("voter"), F.col("entity").alias("card"), "outcome", "pk")
    log = votes.where("pk % 5 = 0").select("voter", F.when(F.col("outcome").isin("purchase", "error"), "likely").otherwise("fresh").alias("lane"))
    return Q.drawn(votes.select("voter"), pool, votes.select("voter", "card"), log, 60)


@query("drv_10_pool_draw", "with s as (select pk, least(cast(floor(pk * 10 / (select max(pk) + 1 from cards)) as int), 9) as stratum from cards where status = 'CONTESTED'), r as (select *, row_number() over (partition by stratum order by md5(cast(pk as string)), pk) as rn from s) select pk from r where rn <= 10 and pk not in (select entity from votes where agent = 'user8')")
def _(i):
    top = i.cards.agg(F.max("pk")).first()[0]
    c = S.stratum(i.cards.where("status = 'CONTESTED'"), "pk", 0, top, 10)
    pool = S.newest(c, ["stratum"], [F.md5(F.col("pk").cast("string").cast("binary")), F.col("pk")], 10).select("pk")
    return pool.join(i.votes.where("agent = 'user8'").select(F.col("entity").alias("pk")), "pk", "left_anti")


@query("drv_11_point_lookup", "select c.pk, c.identifier, p.set_code, v.n from cards c left join printings p on p.pk = c.canonical_pk left join (select entity, count(*) as n from votes group by 1) v on v.entity = c.pk where c.identifier in ('c5', 'c6', 'c12', 'c999', 'c1500')")
def _(i):
    wanted = i.spark.createDataFrame([(x,) for x in ("c5", "c6", "c12", "c999", "c1500")], "identifier string")
    c = i.cards.join(F.broadcast(wanted), "identifier", "left_semi").select("pk", "identifier", "canonical_pk")
    p = i.printings.select(F.col("pk").alias("canonical_pk"), "set_code")
    v = i.votes.groupBy(F.col("entity").alias("pk")).agg(F.count("*").alias("n"))
    return c.join(p, "canonical_pk", "left").join(v, "pk", "left").select("pk", "identifier", "set_code", "n")


@query("drv_12_artist_candidates")
def _(i):
    """Distinct artists in the order of their first candidate; ranked by similarity to what was read."""
    first = i.printings.groupBy("artist").agg(F.min("pk").alias("position"))
    return first.withColumn("ratio", indel_similarity(F.lower("artist"), F.lit("standart"))).orderBy(F.desc("ratio"), "position")


@query("drv_13_tag_tree", "select p.pk, p.name, coalesce(array_to_string(list(c.name order by c.pk) filter (where c.pk is not null), ','), '') as children from tags p left join tags c on c.parent_pk = p.pk and c.pk <> p.pk group by 1, 2")
def _(i):
    kids = i.tags.where("parent_pk is not null and pk <> parent_pk").groupBy(F.col("parent_pk").alias("pk")).agg(F.array_sort(F.collect_list(F.struct("pk", "name"))).alias("c"))
    return i.tags.join(kids, "pk", "left").select("pk", "name", F.coalesce(F.array_join(F.transform("c", lambda x: x["name"]), ","), F.lit("")).alias("children"))


@query("drv_14_first_pages", "with r as (select source_pk, pk, count(*) over (partition by source_pk) as total, row_number() over (partition by source_pk order by created_day desc, pk) as rn from cards where created_day >= 300) select source_pk, pk, total, cast(ceil(total / 12.0) as bigint) as pages from r where rn <= 12")
def _(i):
    recent = i.cards.where("created_day >= 300")
    totals = recent.groupBy("source_pk").agg(F.count("*").alias("total"))
    first = S.newest(recent, ["source_pk"], [F.desc("created_day"), F.col("pk")], 12)
    return first.join(totals, "source_pk").select("source_pk", "pk", "total", F.ceil(F.col("total") / 12.0).alias("pages"))


@query("drv_15_atomic_members", "with r as (select pk, cast(floor(pk / 3) as bigint) as request, phash from cards), g as (select request, count(*) = count(phash) and count(distinct phash) = 1 as accepted from r group by 1) select pk, accepted from r join g using (request)")
def _(i):
    """A request of several members is accepted if all are of one group, else none is."""
    r = i.cards.select("pk", F.floor(F.col("pk") / 3).alias("request"), "phash")
    one = (F.count("*") == F.count("phash")) & (F.min("phash").eqNullSafe(F.max("phash")))
    return r.join(r.groupBy("request").agg(one.alias("accepted")), "request").select("pk", "accepted")


@query("drv_16_whole_pipeline", f"with {JUDGED}, {WEIGHED}, d as (select card_pk as entity, outcome, 0.5 as weight, false as human, false as implicit, false as privileged from v where outcome is not null union all select entity, outcome, weight, human, implicit, privileged from weighed), {consensus_sql('d')} select entity, resolved from final")
def _(i):
    columns = ["entity", "outcome", "weight", "human", "implicit", "privileged"]
    machine = judged(i).where("v.outcome is not null").select(F.col("card_pk").alias("entity"), F.col("v.outcome").alias("outcome"), F.lit(0.5).alias("weight"), *[F.lit(False).alias(k) for k in columns[3:]])
    return C.consensus(machine.unionByName(weighed(i).select(*columns))).select("entity", "resolved")


@query("drv_17_candidates_of_artwork", "select c.pk, count(p.pk) as n, min(p.pk) as least from cards c join printings p on p.name = c.base_name and p.illustration = c.pk % 97 group by 1")
def _(i):
    p = i.printings.select(F.col("pk").alias("p"), F.col("name").alias("base_name"), "illustration")
    return i.cards.select("pk", "base_name", (F.col("pk") % 97).alias("illustration")).join(p, ["base_name", "illustration"]).groupBy("pk").agg(F.count("p").alias("n"), F.min("p").alias("least"))


@query("drv_19_link_map", "select n_regionkey, 'NATION_' || cast(max(n_nationkey) as string) as last_name, count(distinct n_nationkey % 3) as keys from nation group by 1")
def _(i):
    n = i.nation.withColumn("k", F.col("n_nationkey") % 3)
    last = n.groupBy("n_regionkey", "k").agg(F.max_by("n_name", "n_nationkey").alias("v"), F.max("n_nationkey").alias("m"))
    m = last.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("links"), F.max_by("v", "m").alias("last_name"))
    return m.select("n_regionkey", "last_name", F.size("links").cast("long").alias("keys"))


@query("drv_20_engine_comparison", "with a as (select card_pk, max(reason) as a from scans where engine = 'engine0' group by 1), b as (select card_pk, max(reason) as b from scans where engine = 'engine1' group by 1) select a, b, count(*) as n from a join b using (card_pk) group by 1, 2")
def _(i):
    side = lambda e, n: i.scans.where(F.col("engine") == e).groupBy("card_pk").agg(F.max("reason").alias(n))
    return side("engine0", "a").join(side("engine1", "b"), "card_pk").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("stm_9_changed_groups", "with s as (select entity, agent, array_to_string(list_sort(list(distinct outcome)), ',') as o from votes where ts < timestamp '2024-01-16 00:00:00' and agent is not null group by 1, 2), p as (select entity, agent, array_to_string(list_sort(list(distinct outcome)), ',') as o from votes where ts >= timestamp '2024-01-10 00:00:00' and agent is not null group by 1, 2) select v.pk from votes v join p on p.entity = v.entity and p.agent = v.agent left join s on s.entity = v.entity and s.agent = v.agent where v.ts >= timestamp '2024-01-10 00:00:00' and (s.o is null or s.o <> p.o)")
def _(i):
    v = i.votes.where("agent is not null")
    return V.new_groups(v.where("ts >= '2024-01-10'"), v.where("ts < '2024-01-16'"), ["entity", "agent"], "outcome").select("pk")


@query("udf_1_calculator_contract", "select 'artist' as calculator, count(*) as n_votes from printings where artist = 'PROMO' union all select 'layout', count(*) from printings where layout <> 'normal'")
def _(i):
    calculators = {"artist": F.when(F.col("artist") == "PROMO", F.lit("promo")), "layout": F.when(F.col("layout") != "normal", F.col("layout"))}
    votes = F.explode(F.array(*[F.struct(F.lit(n).alias("calculator"), c.alias("outcome")) for n, c in calculators.items()]))
    return i.printings.select(votes.alias("v")).where("v.outcome is not null").groupBy("v.calculator").agg(F.count("*").alias("n_votes"))


@query("udtf_1_candidate_rows", "select c.pk, p.pk as candidate, row_number() over (partition by c.pk order by p.popularity desc nulls last, p.pk) as rank from cards c join printings p on p.name = c.base_name")
def _(i):
    p = i.printings.select(F.col("name").alias("base_name"), F.col("pk").alias("candidate"), "popularity")
    place = F.row_number().over(Window.partitionBy("pk").orderBy(F.desc_nulls_last("popularity"), "candidate"))
    return i.cards.select("pk", "base_name").join(p, "base_name").select("pk", "candidate", place.cast("long").alias("rank"))


@query("udtf_1_candidates_in_sql", "select c.pk, p.pk as candidate, p.popularity from cards c join printings p on p.name = c.base_name")
def _(i):
    """Names to candidates by a table function that SQL calls laterally."""
    tables.register(i.spark, i.printings)
    return i.spark.sql("select c.pk, k.candidate, k.popularity from {cards} c, lateral candidates_of(c.base_name) k", cards=i.cards.select("pk", "base_name"))


@query(
    "udtf_1_deck_lines_in_sql",
    """with d as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, concat(case when l_linenumber % 3 = 0 then '' else concat(cast(cast(l_quantity as int) as string), case when l_linenumber % 2 = 0 then 'x ' else '  ' end) end, 'part ', cast(l_partkey as string), case when l_linenumber % 2 = 0 then concat(' // ', l_returnflag) else ' ' end)) as n, l_linenumber, l_partkey, l_quantity, l_returnflag from lineitem)
    select l_orderkey, cast(2 * n - 1 as int) as line, case when l_linenumber % 3 = 0 then 1 else cast(l_quantity as int) end as quantity, concat('part ', cast(l_partkey as string)) as front, case when l_linenumber % 2 = 0 then l_returnflag end as back from d""",
)
def _(i):
    """The lines of each order as a deck's text with blank lines between, taken apart by a table function in SQL."""
    count = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "x ").otherwise("  ")))
    line = F.concat(count, F.lit("part "), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" // "), "l_returnflag")).otherwise(" "))
    decks = i.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("deck"))
    tables.register(i.spark)
    return i.spark.sql("select id as l_orderkey, line, quantity, front, back from deck_lines(table(select l_orderkey, deck from {decks}))", decks=decks)


# --- whole runs ---------------------------------------------------------------------------------

SHARED = """own as (select card_pk as pk, outcome from v where outcome is not null),
    of_md5 as (select md5 as value, min(outcome) as outcome, min(pk) as source from cards join own using (pk) where md5 <> '' group by 1 having min(outcome) = max(outcome)),
    of_hash as (select phash as value, min(outcome) as outcome, min(pk) as source from cards join own using (pk) where phash is not null group by 1 having min(outcome) = max(outcome)),
    given as (select pk, coalesce(m.outcome, h.outcome) as outcome, case when m.outcome is not null then 'md5' else 'phash' end as via from cards c left join of_md5 m on m.value = c.md5 left join of_hash h on h.value = c.phash
        where pk not in (select pk from own) and coalesce(m.outcome, h.outcome) is not null)"""
MACHINE = f"with {JUDGED}, {SHARED}, {WEIGHED}, d as (select pk as entity, outcome, 0.5 as weight, false as human, false as implicit, false as privileged from (select pk, outcome from own union all select pk, outcome from given) union all select entity, outcome, weight, human, implicit, privileged from weighed), {consensus_sql('d')}"
VOTE = ["entity", "outcome", "weight", "human", "implicit", "privileged"]


def machine_votes(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("entity"), "outcome", F.lit(0.5).alias("weight"), *[F.lit(False).alias(k) for k in VOTE[3:]])


def whole_run(i: Inputs, folder: str, killed_at: str | None = None) -> R.Run:
    """Verdicts, what equal pictures share, consensus and a report by channel; ``killed_at`` ends the run once at that stage."""
    killed = []

    def verdicts(t):
        return judged(i).where("v.outcome is not null").select(F.col("card_pk").alias("pk"), F.col("v.outcome").alias("outcome"))

    def shared(t):
        return R.shared_verdicts(t["cards"].select("pk", "md5", "phash"), t["verdicts"], "pk", ["md5", "phash"])[0]

    def resolved(t):
        votes = machine_votes(t["verdicts"], "pk").unionByName(machine_votes(t["shared"], "pk")).unionByName(t["votes"].select(*VOTE))
        return C.consensus(votes).select("entity", "resolved")

    def report(t):
        parts = [t["verdicts"].select(F.lit("own").alias("channel")), t["shared"].select("via"), t["votes"].select(F.col("source"))]
        return parts[0].union(parts[1]).union(parts[2]).groupBy("channel").agg(F.count("*").alias("n"))

    def once(name, step):
        def run(t):
            if name == killed_at and not killed:
                killed.append(name)
                raise KeyboardInterrupt(name)
            return step(t)

        return R.Stage(name, run, gates.get(name, {}))

    gates = {"consensus": {"resolved without a human": lambda t: t["consensus"].where("resolved is not null").join(t["votes"].where("human").select("entity"), "entity", "left_anti")}}
    checks = {"a card without a key": lambda t: t["cards"].where("pk is null"), "a key of two cards": lambda t: t["cards"].groupBy("pk").agg(F.count("*").alias("n")).where("n > 1")}
    stages = [once(n, f) for n, f in (("verdicts", verdicts), ("shared", shared), ("consensus", resolved), ("report", report))]
    return R.Run(i.spark, folder, "run", stages, checks)


def resumed(i: Inputs) -> tuple[R.Run, dict[str, DataFrame]]:
    """A run that is killed at its third stage and started again."""
    run = whole_run(i, f"{shared_folder(i.spark)}/whole-{uuid.uuid4().hex}", killed_at="consensus")
    inputs = {"cards": i.cards, "votes": weighed(i)}
    try:
        run.go(inputs)
    except KeyboardInterrupt:
        pass
    return run, run.go(inputs)


@query("drv_16_resumed_run", f"{MACHINE} select entity, resolved from final")
def _(i):
    return resumed(i)[1]["consensus"]


@query("drv_16_run_ledger", f"""{MACHINE} select 1 as ordinal, 'verdicts' as stage, count(*) as rows_out from own union all select 2, 'shared', count(*) from given union all select 3, 'consensus', count(*) from final
    union all select 4, 'report', (select count(distinct source) from votes) + (select count(distinct via) from given) + (select least(count(*), 1) from own)""")
def _(i):
    """The ledger of a run that was killed between its stages: each is completed once."""
    return resumed(i)[0].ledger().where("status = 'completed'").select("ordinal", "stage", "rows_out")


@query("drv_16_channel_report", f"{MACHINE} select 'own' as channel, count(*) as n from own group by 1 union all select via, count(*) from given group by 1 union all select source, count(*) from votes group by 1")
def _(i):
    return resumed(i)[1]["report"]


def stored_verdicts(i: Inputs) -> DataFrame:
    """What the calculator voted before: every third of its verdicts, and an outdated one for some rows."""
    found = judged(i).where("v.outcome is not null and card_pk % 3 = 0").select("card_pk", F.col("v.outcome").alias("outcome"))
    return found.unionByName(i.cards.where("pk % 5 = 0").select(F.col("pk").alias("card_pk"), F.lit("outdated").alias("outcome")))


@query("drv_4_run_counts", f"""with {JUDGED}, a as (select *, card_pk % 3 = 0 as known from v)
    select case when dry then 'dry run' else 'run' end as mode, counter, count(*) as n from (values (true), (false)) m(dry), (select card_pk, unnest(['considered', case when outcome is not null then 'cast' else concat('skipped: ', skip_reason) end, case when outcome is not null then case when known then 'already' else 'new' end end]) as c, outcome from a) b,
    lateral (select case when c = 'new' then case when dry then 'withheld' else 'written' end else c end as counter) x where c is not null group by 1, 2""")
def _(i):
    """Counters of a run and of its dry run over the same stored verdicts."""
    rows, stored = judged(i), stored_verdicts(i)
    count = lambda dry: R.calculator_counts(rows, stored, "card_pk", F.col("v.outcome"), F.col("v.skip_reason"), dry).select(F.lit("dry run" if dry else "run").alias("mode"), "counter", "n")
    return count(False).unionByName(count(True))


@query("drv_6_two_engines", f"""with {JUDGED}, a as (select card_pk as pk, outcome from v where outcome is not null), b as (select c.pk, cast(min(p.pk) as string) as outcome from cards c join printings p on p.image_hash = c.phash and p.name = c.base_name group by 1)
    select pk, case when a.outcome <> b.outcome then null else coalesce(a.outcome, b.outcome) end as outcome, case when a.outcome <> b.outcome then null when b.outcome is null then 'one' when a.outcome is null then 'two' else 'both' end as engine, case when a.outcome <> b.outcome then 'engines-disagree' else '' end as skip_reason from a full join b using (pk)""")
def _(i):
    """The reading of small print and the equality of hashes as two engines."""
    one = judged(i).where("v.outcome is not null").select(F.col("card_pk").alias("pk"), F.col("v.outcome").alias("outcome"))
    p = i.printings.select(F.col("pk").alias("printing"), F.col("name").alias("base_name"), F.col("image_hash").alias("phash"))
    two = i.cards.select("pk", "base_name", "phash").join(p, ["base_name", "phash"]).groupBy("pk").agg(F.min("printing").cast("string").alias("outcome"))
    return R.two_engines(one, two, "pk")


# --- the ladder of a match ------------------------------------------------------------------------

FRAME_READ = "case when content_hash % 5 = 0 then '' when content_hash % 2 = 0 then 'old' else 'modern' end"
FRAME_KNOWN = "case when popularity is null then 'future' when released_year < 1998 then '1993' when released_year < 2003 then '1997' when released_year < 2015 then '2003' else '2015' end"
FRAME_CLASS = f"case {FRAME_KNOWN} when '1993' then 'old' when '1997' then 'old' when 'future' then '' else 'modern' end"
GLYPH = 1229782938247303441
COARSE = JUDGED.replace("cast(cast(p.number as bigint) as string) = l.number", "cast(cast(p.number as bigint) % 3 as string) = cast(try_cast(l.number as bigint) % 3 as string)")
LADDER = f"""with {COARSE}, tied as (select j.card_pk, p.pk as candidate, p.set_code, case when (content_hash + 1) % 9 < 8 then xor(cast((content_hash + 1) % 9 as bigint) * {GLYPH}, cast(content_hash % 32 as bigint)) end as symbol from j join printings p on p.name = j.name and cast(p.number as bigint) % 3 = try_cast(j.number as bigint) % 3 and (j.set_code = '' or j.set_code = p.set_code) where j.reason = 'ambiguous'),
    near as (select card_pk, set_code, min(bit_count(xor(symbol, cast(substr(set_code, 2) as bigint) * {GLYPH}))) as d from tied where set_code <> 's8' and symbol is not null group by 1, 2),
    best as (select *, row_number() over (partition by card_pk order by d, set_code) as rn, lead(d) over (partition by card_pk order by d, set_code) as next from near),
    broken as (select t.card_pk, min(t.candidate) as candidate from tied t join best b on b.card_pk = t.card_pk and b.set_code = t.set_code where rn = 1 and d <= 6 and (next is null or next - d > 6) group by 1),
    m as (select v.card_pk, coalesce(j.match, b.candidate) as matched, case when j.match is null and b.candidate is not null then 0.75 else v.confidence end as base, v.outcome, v.skip_reason from v join j using (card_pk) left join broken b using (card_pk)),
    lad as (select m.*, case when truncated then 'truncated-image' when {FRAME_READ} <> '' and {FRAME_CLASS} <> '' and {FRAME_READ} <> {FRAME_CLASS} then 'frame-mismatch' when p.released_year - l.year > 2 then 'copyright-year-mismatch'
        when content_hash % 3 = 0 and l.artist <> '' and lower(l.artist) <> lower(p.artist) then 'artist-mismatch' else '' end as veto, (l.border <> '' and l.border <> p.border) or (l.artist <> '' and lower(l.artist) <> lower(p.artist)) as weak from m join l using (card_pk) left join printings p on p.pk = m.matched),
    fin as (select card_pk, case when matched is null then outcome when veto = '' then cast(matched as string) end as outcome, cast(case when matched is null then base when veto = '' then case when weak then least(base, 0.65) else base end end as double) as confidence, case when matched is null then skip_reason else veto end as skip_reason from lad)"""


def tie_breaks(i: Inputs) -> DataFrame:
    """(card_pk, candidate): ambiguous readings whose symbol tells the set; sets 0 to 7 have a glyph."""
    j = judged(i, 3).where("reason = 'ambiguous'")
    p = i.printings.select("name", (F.col("number").cast("long") % 3).cast("string").alias("number"), F.col("set_code").alias("known"), F.col("pk").alias("candidate"))
    tied = j.select("card_pk", "name", "number", "set_code").join(p, ["name", "number"]).where("set_code = '' or set_code = known").select("card_pk", "candidate", F.col("known").alias("set_code"))
    symbols = j.select("card_pk", F.when((F.col("content_hash") + 1) % 9 < 8, (((F.col("content_hash") + 1) % 9).cast("long") * GLYPH).bitwiseXOR((F.col("content_hash") % 32).cast("long"))).alias("symbol"))
    glyphs = i.spark.range(8).select(F.concat(F.lit("s"), "id").alias("set_code"), (F.col("id") * GLYPH).alias("glyph"))  # a row a set
    return V.ties_broken(symbols, tied, glyphs, "card_pk")


def laddered(i: Inputs) -> DataFrame:
    """(card_pk, outcome, confidence, skip_reason): verdicts after ties are broken and all rungs are climbed."""
    rows = judged(i, 3).join(tie_breaks(i), "card_pk", "left").withColumn("matched", F.coalesce("match", "candidate"))
    p = i.printings.select(F.col("pk").alias("matched"), F.col("border").alias("kb"), F.col("artist").alias("ka"), "released_year", F.expr(FRAME_KNOWN).alias("kf"))
    base = F.when(F.col("match").isNull() & F.col("candidate").isNotNull(), V.SYMBOL_TIE).otherwise(F.col("v.confidence"))
    line = F.when(F.col("content_hash") % 3 == 0, F.col("artist")).otherwise("")
    rungs = V.ladder(base, truncated=F.col("truncated"), border=F.col("border"), known_border=F.col("kb"), frame=F.expr(FRAME_READ), known_frame=F.col("kf"), year=F.col("year"), released=F.col("released_year"), line_artist=line, artist=F.col("artist"), known_artist=F.col("ka"))
    climbed = rows.join(p, "matched", "left").withColumn("r", rungs)
    hit, free = F.col("matched").isNotNull(), F.col("r.skip_reason") == ""
    return climbed.select("card_pk", F.when(~hit, F.col("v.outcome")).when(free, F.col("matched").cast("string")).alias("outcome"), F.when(hit, F.col("r.confidence")).otherwise(F.col("v.confidence")).alias("confidence"), F.when(hit, F.col("r.skip_reason")).otherwise(F.col("v.skip_reason")).alias("skip_reason"))


@query("ver_1_tie_breaks", f"{LADDER} select card_pk, candidate from broken")
def _(i):
    return tie_breaks(i)


@query("ver_2_ladder", f"{LADDER} select card_pk, outcome, confidence, skip_reason from fin")
def _(i):
    return laddered(i)


@query("ver_12_recovery_pass", f"""{LADDER}, w as (select fin.card_pk, p.pk, p.artist, bit_count(xor(c.phash, p.image_hash)) as d from fin join cards c on c.pk = fin.card_pk join printings p on p.name = c.base_name where fin.skip_reason = 'frame-mismatch' and c.phash is not null),
    k as (select *, row_number() over (partition by card_pk order by d, pk) as rn, lead(d) over (partition by card_pk order by d, pk) as next from w), won as (select card_pk, artist from k where rn = 1 and d <= 20 and (next is null or next - d > 5))
    select card_pk, 'artist' as kind, artist as outcome, cast(0.8 as double) as confidence from won union all select card_pk, 'tag', 'altered-frame', 0.7 from won""")
def _(i):
    """Rows that their frame withheld, looked at again by their pictures' hashes."""
    withheld = checkpointed(laddered(i).where("skip_reason = 'frame-mismatch'").select("card_pk"))
    c = i.cards.where("phash is not null").select(F.col("pk").alias("card_pk"), F.col("base_name").alias("name"), "phash")
    pairs = withheld.join(c, "card_pk").join(i.printings.select("name", "pk", "image_hash"), "name").select("card_pk", "pk", M.hamming(F.col("phash"), F.col("image_hash")).alias("d"))
    return V.recovered_frames(withheld, M.clear_winner(pairs, "card_pk", "pk", "d", 20, 5), i.printings, "card_pk")


@query("agg_30_elimination", f"""with {LAST}, p as (select concat(name, '/', set_code) as k, min(pk) as printing, min(border) as kb, min({FRAME_CLASS}) as kf from printings where pk not in (select canonical_pk from cards where canonical_pk is not null) group by 1 having count(*) = 1),
    o as (select concat(base_name, '/', expansion_hint) as k, min(pk) as pk from cards where status <> 'RESOLVED' and expansion_hint <> '' group by 1 having count(*) = 1), e as (select card_pk as pk, border, {FRAME_READ} as frame from l where card_pk % 7 <> 0),
    r as (select pk, printing, case when e.border is null then 'no-evidence' when border <> '' and border <> kb then 'border-mismatch' when frame <> '' and kf <> '' and frame <> kf then 'frame-mismatch' else '' end as reason from o join p using (k) left join e using (pk))
    select pk, case when reason = '' then printing end as printing, reason from r""")
def _(i):
    """The only open row and the only uncovered printing of a name in a set, if the row's picture agrees."""
    covered = i.cards.where("canonical_pk is not null").select(F.col("canonical_pk").alias("pk")).distinct()
    uncovered = i.printings.join(covered, "pk", "left_anti").select(F.concat_ws("/", "name", "set_code").alias("k"), F.col("pk").alias("printing"), "border", F.expr(FRAME_KNOWN).alias("frame"))
    open_rows = i.cards.where("status <> 'RESOLVED' and expansion_hint <> ''").select(F.concat_ws("/", "base_name", "expansion_hint").alias("k"), "pk")
    read = one_reading(i).where("card_pk % 7 <> 0").select(F.col("card_pk").alias("pk"), "border", F.expr(FRAME_READ).alias("frame"))
    return V.eliminated(open_rows, uncovered, read, "k", "pk")
