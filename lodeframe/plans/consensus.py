"""Queries of weighted consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import agent_key
from ..operators import consensus as C
from .registry import Inputs, query

RULES = C.Rules(frozen=(("engine3", "run4"),))

# Weighted votes in SQL; the sums of weights are multiples of a quarter, so doubles are exact.
WEIGHED = """weighed as (select *, source in ('user', 'admin') as human, source = 'implicit' as implicit, source = 'admin' as privileged,
    case when source = 'deduction' and agent like 'engine3-v%' and run_id = 'run4' then 0.0 when source = 'admin' then 5.0 when source in ('user', 'federated') then 1.0 when source in ('ocr', 'deduction') then 0.5 else 0.25 end as weight from votes)"""
POOLED = """pooled as (select entity, max(outcome) as outcome, max(weight) as weight, bool_or(human and weight = top) as human, bool_or(implicit and weight = top) as implicit, bool_or(privileged and weight = top) as privileged
    from (select *, regexp_replace(agent, '-v[0-9]+$', '') as k, max(weight) over (partition by entity, regexp_replace(agent, '-v[0-9]+$', '')) as top from weighed where agent is not null) group by entity, k having count(distinct outcome) = 1
    union all select entity, outcome, weight, human, implicit, privileged from weighed where agent is null)"""


def consensus_sql(votes: str, group: str = "entity", outcome: str = "outcome") -> str:
    """The named subqueries from votes with weights to ``final`` (entity, winner, weight, share, resolved)."""
    return f"""sums as (select {group} as entity, {outcome} as outcome, sum(case when human then weight else 0.0 end) as hw,
        sum(case when human then weight else 0.0 end) + least(sum(case when not human and not implicit then weight else 0.0 end), 1.0) + least(sum(case when not human and implicit then weight else 0.0 end), 1.0) as fw,
        bool_or(human) as hh, bool_or(privileged) as hp from {votes} group by 1, 2),
    flags as (select entity, count(*) filter (where hh) >= 2 or max(hw) >= 2 as ho from sums group by 1),
    ranked as (select s.entity, outcome, hh, hp, case when ho then hw else fw end as w, sum(case when ho then hw else fw end) over (partition by s.entity) as total,
        row_number() over (partition by s.entity order by case when ho then hw else fw end desc, outcome) as rn from sums s join flags using (entity)),
    final as (select entity, outcome as winner, cast(w as double) as weight, case when total > 0 then cast(w as double) / cast(total as double) else 0.0 end as share, hp,
        case when w >= 2 and cast(w as double) / cast(total as double) >= 0.6 and hh then cast(outcome as string) end as resolved from ranked where rn = 1)"""


def weighed(i: Inputs) -> DataFrame:
    v = i.votes.withColumn("human", F.col("source").isin("user", "admin")).withColumn("implicit", F.col("source") == "implicit").withColumn("privileged", F.col("source") == "admin")
    return v.withColumn("weight", C.vote_weight(F.col("source"), F.col("agent"), F.col("run_id"), F.col("privileged"), RULES))




def final(found: DataFrame) -> DataFrame:
    return found.select("entity", "winner", "weight", F.round("share", 6).alias("share"), "resolved")


FINAL_SQL = "select entity, winner, weight, round(share, 6) as share, resolved from final"


@query("agg_10_weighted_consensus", f"with {WEIGHED}, {consensus_sql('weighed')} {FINAL_SQL}")
def _(i):
    return final(C.consensus(weighed(i), rules=RULES))


@query("agg_11_agent_pooling", f"with {WEIGHED}, {POOLED} select entity, outcome, cast(sum(weight) as double) as weight, count(*) as n, count(*) filter (where human) as n_human from pooled group by 1, 2")
def _(i):
    return C.pooled(weighed(i)).groupBy("entity", "outcome").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.count_if(F.col("human")).alias("n_human"))


@query("agg_12_vote_weight", f"with {WEIGHED} select pk, source, cast(weight as double) as weight from weighed")
def _(i):
    return weighed(i).select("pk", "source", "weight")


@query("agg_13_printing_consensus", f"with {WEIGHED.replace('select *, source in', 'select * exclude (outcome), case when sentinel then ' + chr(39) + 'NO_MATCH' + chr(39) + ' else outcome end as outcome, source in')}, {POOLED}, {consensus_sql('pooled')} {FINAL_SQL}")
def _(i):
    named = weighed(i).withColumn("outcome", F.when(F.col("sentinel"), "NO_MATCH").otherwise(F.col("outcome")))
    return final(C.consensus(C.pooled(named), rules=RULES))


@query("agg_14_tag_consensus_gated", f"with {WEIGHED}, {consensus_sql('weighed', outcome='polarity')} select entity, winner, weight, round(share, 6) as share, case when resolved is not null and not hp then 'PENDING' else resolved end as resolved from final")
def _(i):
    return final(C.consensus(weighed(i), outcome="polarity", rules=RULES, gated=True))


@query("agg_15_artist_consensus", f"with {WEIGHED.replace('select *, source in', 'select * exclude (outcome), case when sentinel then ' + chr(39) + 'UNKNOWN' + chr(39) + ' else outcome end as outcome, source in')}, {consensus_sql('weighed')} {FINAL_SQL}")
def _(i):
    return final(C.consensus(weighed(i).withColumn("outcome", F.when(F.col("sentinel"), "UNKNOWN").otherwise(F.col("outcome"))), rules=RULES))


@query("agg_16_elimination", f"with {WEIGHED} select entity, candidate, cast(sum(weight) as double) as weight from weighed where polarity < 0 group by 1, 2 having sum(weight) >= 2 and bool_or(human)")
def _(i):
    return C.eliminated(weighed(i).where("polarity < 0"), ["entity", "candidate"]).select("entity", "candidate", "weight")


@query("agg_17_vote_tally", "select entity, outcome, count(*) as n from votes group by 1, 2")
def _(i):
    return C.tally(i.votes)


@query("agg_18_net_polarity", f"with {WEIGHED} select entity, candidate, round(coalesce(cast(sum(case when implicit then 0 else polarity * weight end) as double) / nullif(cast(sum(case when implicit then 0 else weight end) as double), 0), 0), 6) as net from weighed group by 1, 2")
def _(i):
    return C.net_polarity(weighed(i), ["entity", "candidate"]).withColumn("net", F.round("net", 6))


@query("agg_19_leaning_tags", f"with {WEIGHED}, s as (select entity, outcome, sum(case when polarity > 0 then weight else 0 end) as a, sum(case when polarity < 0 then weight else 0 end) as r from weighed group by 1, 2) select entity, array_to_string(list_sort(list(outcome)), ',') as tags from s where a >= 1 and a >= r group by 1")
def _(i):
    return C.leaning(weighed(i), "entity", "outcome").select("entity", F.array_join("tags", ",").alias("tags"))


@query("agg_20_entropy", f"with {WEIGHED}, s as (select entity, outcome, sum(weight) as w from weighed group by 1, 2 having sum(weight) > 0), p as (select entity, cast(w as double) / cast(sum(w) over (partition by entity) as double) as p from s) select entity, round(-sum(p * ln(p)), 6) + 0.0 as entropy from p group by 1")
def _(i):
    return C.entropy(weighed(i), "entity", "outcome").select("entity", (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"))


@query("agg_21_deviation", f"with {WEIGHED}, o as (select distinct outcome from votes), s as (select entity, outcome, cast(sum(weight) as double) as w from weighed group by 1, 2), f as (select e.entity, coalesce(w, 0) as w from (select distinct entity from votes) e cross join o left join s using (entity, outcome)) select entity, round(stddev_pop(w), 6) as deviation from f group by 1")
def _(i):
    v = weighed(i)
    return C.weighted_deviation(v, v, "entity", "outcome").withColumn("deviation", F.round("deviation", 6))


@query(
    "agg_22_information_gain",
    f"with {WEIGHED}, h as (select * from weighed where human), s as (select entity, outcome, sum(weight) as w from h group by 1, 2 having sum(weight) > 0), p as (select entity, cast(w as double) / cast(sum(w) over (partition by entity) as double) as p from s), e as (select entity, -sum(p * ln(p)) as entropy from p group by 1), o as (select distinct outcome from votes), t as (select entity, outcome, cast(sum(weight) as double) as w from weighed group by 1, 2), d as (select entity, stddev_pop(w) as deviation from (select e.entity, coalesce(w, 0) as w from (select distinct entity from votes) e cross join o left join t using (entity, outcome)) group by 1) select entity, round(coalesce(entropy, 0.25 * deviation, 0), 5) + 0.0 as score from d left join e using (entity)",
)
def _(i):
    v = weighed(i)
    both = C.weighted_deviation(v, v, "entity", "outcome").join(C.entropy(v.where("human"), "entity", "outcome"), "entity", "left")
    return C.question_score(both).select("entity", (F.round("score", 5) + F.lit(0.0)).alias("score"))


@query("agg_42_likely_resolved", f"with {WEIGHED}, a as (with {consensus_sql('weighed')} select * from final where resolved is null), more as (select entity, outcome, weight, human, implicit, privileged from weighed where entity in (select entity from a) union all select entity, winner, 1.0, true, false, false from a), {consensus_sql('more')} select entity, resolved as would_be from final where resolved is not null")
def _(i):
    return C.likely_resolved(weighed(i), rules=RULES)


@query("agg_34_status_transitions", f"with {WEIGHED}, old as (with b as (select * from weighed where ts < timestamp '2024-01-20 00:00:00'), {consensus_sql('b')} select entity, case when resolved is null then 'UNRESOLVED' else 'RESOLVED' end as status from final), new as (with {consensus_sql('weighed')} select entity, case when resolved is null then 'UNRESOLVED' else 'RESOLVED' end as status from final) select o.status as before, n.status as after, count(*) as n from old o full join new n using (entity) group by 1, 2")
def _(i):
    v, name = weighed(i), F.when(F.col("resolved").isNull(), "UNRESOLVED").otherwise("RESOLVED").alias("status")
    return C.transitions(C.consensus(v.where("ts < '2024-01-20'"), rules=RULES).select("entity", name), C.consensus(v, rules=RULES).select("entity", name), "entity")


TAG_STATUS = f"""{consensus_sql('tagged', outcome='polarity')}, split as (select k, entity_, candidate_, count(distinct case when human then polarity end) > 1 as split from tagged group by 1, 2, 3),
    status as (select entity_ as entity, candidate_ as candidate, case when resolved is not null and candidate_ % 2 = 0 and not hp then 'PENDING' when resolved = '1' then 'RESOLVED_APPLY' when resolved = '-1' then 'RESOLVED_REJECT' when split then 'CONTESTED' else 'UNRESOLVED' end as status from final join split on k = final.entity)"""
TAGGED = "tagged as (select entity * 10 + candidate as k, entity as entity_, candidate as candidate_, * exclude (entity) from weighed)"
TAG_STATUS = f"{TAGGED}, {TAG_STATUS.replace('select entity as entity, polarity as outcome', 'select k as entity, polarity as outcome')}"


def tag_statuses(i: Inputs) -> DataFrame:
    return C.tag_status(weighed(i), ["entity", "candidate"], RULES, F.col("__g.candidate") % 2 == 0)


@query("drv_1_tag_status", f"with {WEIGHED}, {TAG_STATUS} select entity, candidate, status from status")
def _(i):
    return tag_statuses(i)


@query("drv_1_merged_tags", f"with {WEIGHED}, {TAG_STATUS}, p as (select entity, list(concat('tag', cast(candidate as string))) filter (where status = 'RESOLVED_APPLY') as plus, list(concat('tag', cast(candidate as string))) filter (where status = 'RESOLVED_REJECT') as minus from status group by 1) select pk, array_to_string(list_sort(list_distinct(list_filter(list_concat(['tag0', 'zeta'], coalesce(plus, [])), lambda x: not list_contains(coalesce(minus, []), x)))), ',') as tags from cards left join p on entity = pk")
def _(i):
    statuses = tag_statuses(i).select(F.col("entity").alias("pk"), F.concat(F.lit("tag"), F.col("candidate").cast("string")).alias("tag"), "status")
    return C.merged_tags(i.cards.select("pk").withColumn("tags", F.array(F.lit("tag0"), F.lit("zeta"))), statuses, "pk").select("pk", F.array_join("tags", ",").alias("tags"))


SENTINEL = WEIGHED.replace("select *, source in", "select * exclude (outcome), case when sentinel then 'UNKNOWN' else outcome end as outcome, source in")


@query("drv_2_outcome_status", f"with {SENTINEL}, {consensus_sql('weighed')}, n as (select entity, count(distinct outcome) as n from weighed group by 1) select entity, resolved, case when resolved = 'UNKNOWN' then 'UNKNOWN' when resolved is not null then 'RESOLVED' when n > 1 then 'CONTESTED' else 'UNRESOLVED' end as status from final join n using (entity)")
def _(i):
    return C.outcome_status(weighed(i).withColumn("outcome", F.when(F.col("sentinel"), "UNKNOWN").otherwise(F.col("outcome"))), rules=RULES)


@query("agg_3_contested", "select entity, count(distinct case when not sentinel then outcome end) as n_outcomes, count(*) filter (where sentinel) as n_sentinels from votes group by 1 having count(distinct case when not sentinel then outcome end) > 1 or (count(distinct case when not sentinel then outcome end) >= 1 and count(*) filter (where sentinel) > 0)")
def _(i):
    return C.contested(i.votes.withColumn("outcome", F.when(~F.col("sentinel"), F.col("outcome"))), ["entity"], "outcome", "sentinel")


@query("drv_3_contested_pairs", "select entity, candidate, count(distinct polarity) as n_outcomes from votes group by 1, 2 having count(distinct polarity) > 1")
def _(i):
    return C.contested(i.votes, ["entity", "candidate"], "polarity")


@query("str_25_agent_key", "select pk, case when regexp_matches(agent, '^.+-v[0-9]+$') then regexp_replace(agent, '-v[0-9]+$', '') else agent end as agent from votes")
def _(i):
    return i.votes.select("pk", agent_key(F.col("agent")).alias("agent"))


@query("udaf_1_consensus_summary", f"with {WEIGHED}, {consensus_sql('weighed')} select count(*) as n, count(resolved) as n_resolved, round(avg(share), 4) as mean_share from final")
def _(i):
    return C.consensus(weighed(i), rules=RULES).agg(F.count("*").alias("n"), F.count("resolved").alias("n_resolved"), F.round(F.avg("share"), 4).alias("mean_share"))


@query("drv_8_fidelity_gate", f"with {WEIGHED}, run as (select distinct entity from weighed where run_id = 'run4' and not human), machine as (select * from weighed where not human and entity in (select entity from run)), {consensus_sql('machine')} select entity, resolved is null as holds, winner from final")
def _(i):
    """For each entity that a run touched: machine votes alone must not resolve it."""
    v = weighed(i)
    touched = v.where((F.col("run_id") == "run4") & ~F.col("human")).select("entity").distinct()
    machine = C.consensus(v.where(~F.col("human")).join(touched, "entity", "left_semi"), rules=RULES)
    return machine.select("entity", F.col("resolved").isNull().alias("holds"), "winner")


@query("dml_2_retract_run", f"with {WEIGHED}, kept as (select * from weighed where run_id <> 'run4' and entity in (select entity from weighed where run_id = 'run4')), {consensus_sql('kept')} {FINAL_SQL}")
def _(i):
    v = weighed(i)
    gone = v.where(F.col("run_id") == "run4").select("entity").distinct()
    return final(C.consensus(v.where(F.col("run_id") != "run4").join(gone, "entity", "left_semi"), rules=RULES))


@query("drv_18_implicit_retract", f"with {WEIGHED}, kept as (select * from weighed where source <> 'implicit'), {consensus_sql('kept', outcome='polarity')} {FINAL_SQL}")
def _(i):
    return final(C.consensus(weighed(i).where("source <> 'implicit'"), outcome="polarity", rules=RULES))
