"""Weighted consensus over votes: weights, agent pooling, capped sums, gates, tallies and statuses.

All of it is aggregation over one long votes table.  Pooling groups by (group, agent), sums by
(group, outcome), and the winner by group, so a hot group shrinks before it is gathered: only
its distinct outcomes meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import agent_key, calculator_family


@dataclass(frozen=True)
class Rules:
    """Fixed values of the consensus; weights by source."""

    least_weight: float = 2.0
    least_share: float = 0.6
    machine_cap: float = 1.0
    implicit_cap: float = 1.0
    privileged_weight: float = 5.0
    weights: tuple[tuple[str, float], ...] = (("user", 1.0), ("admin", 5.0), ("deduction", 0.5), ("ocr", 0.5), ("federated", 1.0), ("implicit", 0.25))
    human: tuple[str, ...] = ("user", "admin")
    #: (family, run) of a frozen cohort of deductions, whose votes weigh nothing.
    frozen: tuple[tuple[str, str], ...] = ()


PENDING = "PENDING"


def vote_weight(source: Column, agent: Column, run_id: Column, privileged: Column, rules: Rules = Rules()) -> Column:
    """Weight by source, 0 for a frozen cohort, and at least the privileged weight for a privileged voter."""
    weight = F.lit(0.0)
    for name, value in rules.weights:
        weight = F.when(source == name, F.lit(value)).otherwise(weight)
    for family, run in rules.frozen:
        weight = F.when((source == "deduction") & (calculator_family(agent) == family) & (run_id == run), F.lit(0.0)).otherwise(weight)
    return F.when(privileged, F.greatest(weight, F.lit(rules.privileged_weight))).otherwise(weight)


def pooled(votes: DataFrame, group: str = "entity", agent: str = "agent", outcome: str = "outcome") -> DataFrame:
    """One vote for each agent and group: the heaviest if the agent always says the same, none if it contradicts itself.

    Needs columns weight, human, implicit and privileged.  Votes without an agent pass as they are.  Of
    equally heavy votes of an agent a human one is kept.
    """
    keys = [group, outcome, "weight", "human", "implicit", "privileged"]
    named = votes.where(F.col(agent).isNotNull()).withColumn("__agent", agent_key(F.col(agent)))
    best = F.max(F.struct("weight", "human", "implicit", "privileged"))
    one = named.groupBy(group, "__agent").agg(F.min(outcome).alias("lo"), F.max(outcome).alias(outcome), best.alias("b")).where(F.col("lo") == F.col(outcome))
    return one.select(group, outcome, "b.weight", "b.human", "b.implicit", "b.privileged").unionByName(votes.where(F.col(agent).isNull()).select(*keys))


def outcome_sums(votes: DataFrame, group: str = "entity", outcome: str = "outcome", rules: Rules = Rules()) -> DataFrame:
    """By (group, outcome): human, capped machine and capped implicit weight, and whether a human or privileged vote is in it."""
    zero = F.lit(0.0)
    return (
        votes.groupBy(group, outcome)
        .agg(
            F.sum(F.when(F.col("human"), F.col("weight")).otherwise(zero)).alias("human_weight"),
            F.sum(F.when(~F.col("human") & ~F.col("implicit"), F.col("weight")).otherwise(zero)).alias("machine"),
            F.sum(F.when(~F.col("human") & F.col("implicit"), F.col("weight")).otherwise(zero)).alias("soft"),
            F.max("human").alias("has_human"),
            F.max("privileged").alias("has_privileged"),
            F.count("*").alias("n_votes"),
        )
        .withColumn("full_weight", F.col("human_weight") + F.least("machine", F.lit(rules.machine_cap)) + F.least("soft", F.lit(rules.implicit_cap)))
        .drop("machine", "soft")
    )


def consensus(votes: DataFrame, group: str = "entity", outcome: str = "outcome", rules: Rules = Rules(), gated: bool = False) -> DataFrame:
    """(group, winner, weight, share, resolved): the outcome that a group agrees on, null if it does not.

    Votes by others than humans count only while humans neither disagree nor suffice.  The winner
    needs the least weight, the least share of all weight, and a human vote; with ``gated`` and no
    privileged vote in it, resolved is PENDING.  Ties go to the smaller outcome.
    """
    sums = outcome_sums(votes, group, outcome, rules)
    totals = sums.groupBy(group).agg(
        ((F.count_if(F.col("has_human")) >= 2) | (F.max("human_weight") >= rules.least_weight)).alias("humans_only"),
        F.sum("human_weight").alias("human_total"),
        F.sum("full_weight").alias("full_total"),
        F.min(F.struct((-F.col("human_weight")).alias("w"), F.col(outcome).alias("o"), "has_human", "has_privileged")).alias("by_human"),
        F.min(F.struct((-F.col("full_weight")).alias("w"), F.col(outcome).alias("o"), "has_human", "has_privileged")).alias("by_full"),
    )
    best = F.when(F.col("humans_only"), F.col("by_human")).otherwise(F.col("by_full"))
    total = F.when(F.col("humans_only"), F.col("human_total")).otherwise(F.col("full_total"))
    rows = totals.select(group, best.alias("b"), total.alias("total"))
    weight = -F.col("b.w")
    share = F.when(F.col("total") > 0, weight / F.col("total")).otherwise(F.lit(0.0))
    won = (weight >= rules.least_weight) & (share >= rules.least_share) & F.col("b.has_human")
    resolved = F.when(won, F.when(F.lit(gated) & ~F.col("b.has_privileged"), F.lit(PENDING)).otherwise(F.col("b.o").cast("string")))
    return rows.select(group, F.col("b.o").alias("winner"), weight.alias("weight"), share.alias("share"), resolved.alias("resolved"))


def tally(votes: DataFrame, group: str = "entity", outcome: str = "outcome") -> DataFrame:
    """Plain counts of votes by outcome, most first."""
    return votes.groupBy(group, outcome).agg(F.count("*").alias("n")).orderBy(group, F.desc("n"), outcome)


def contested(votes: DataFrame, group: list[str], outcome: str, sentinel: str | None = None) -> DataFrame:
    """Groups with more than one distinct non-null outcome, or with one and a sentinel vote."""
    flags = [F.countDistinct(outcome).alias("n_outcomes")] + ([F.count_if(F.col(sentinel)).alias("n_sentinels")] if sentinel else [])
    found = votes.groupBy(*group).agg(*flags)
    rule = F.col("n_outcomes") > 1
    return found.where(rule | ((F.col("n_outcomes") >= 1) & (F.col("n_sentinels") > 0)) if sentinel else rule)


def net_polarity(votes: DataFrame, group: list[str], polarity: str = "polarity") -> DataFrame:
    """Weighted mean of polarities without implicit votes; 0 where no weight is left."""
    w = F.when(F.col("implicit"), F.lit(0.0)).otherwise(F.col("weight"))
    return votes.groupBy(*group).agg(F.coalesce(F.sum(F.col(polarity) * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0)).alias("net"))


def leaning(votes: DataFrame, entity: str, tag: str, polarity: str = "polarity", least: float = 1.0) -> DataFrame:
    """By entity the sorted tags whose weight for is at least ``least`` and not below the weight against."""
    w = F.col("weight")
    sums = votes.groupBy(entity, tag).agg(F.sum(F.when(F.col(polarity) > 0, w).otherwise(0.0)).alias("apply"), F.sum(F.when(F.col(polarity) < 0, w).otherwise(0.0)).alias("reject"))
    return sums.where((F.col("apply") >= least) & (F.col("apply") >= F.col("reject"))).groupBy(entity).agg(F.array_sort(F.collect_list(tag)).alias("tags"))


def eliminated(votes: DataFrame, group: list[str], rules: Rules = Rules()) -> DataFrame:
    """Candidates (group includes the candidate's column) that rejections rule out: the weight suffices and a human is in it."""
    sums = votes.groupBy(*group).agg(F.sum("weight").alias("weight"), F.max("human").alias("has_human"))
    return sums.where((F.col("weight") >= rules.least_weight) & F.col("has_human"))


def entropy(votes: DataFrame, group: str, outcome: str) -> DataFrame:
    """Shannon entropy in nats of a group's weights by outcome; weights of 0 or less do not count."""
    sums = votes.groupBy(group, outcome).agg(F.sum("weight").alias("w")).where("w > 0")
    total = F.sum("w").over(Window.partitionBy(group))
    p = F.col("w") / F.col("total")
    return sums.withColumn("total", total).groupBy(group).agg((-F.sum(p * F.log(p))).alias("entropy"))


def weighted_deviation(votes: DataFrame, outcomes: DataFrame, group: str, outcome: str) -> DataFrame:
    """Population deviation of a group's weights over all outcomes, those without votes counting 0.

    Needs no cross join: with k outcomes and sums s1, s2 of weights and squares it is sqrt(s2/k - (s1/k)^2).
    """
    k = outcomes.select(outcome).distinct().agg(F.count("*").alias("k"))
    sums = votes.groupBy(group, outcome).agg(F.sum("weight").alias("w")).groupBy(group).agg(F.sum("w").alias("s1"), F.sum(F.col("w") * F.col("w")).alias("s2"))
    mean = F.col("s1") / F.col("k")
    return sums.crossJoin(F.broadcast(k)).select(group, F.sqrt(F.greatest(F.col("s2") / F.col("k") - mean * mean, F.lit(0.0))).alias("deviation"))


def question_score(found: DataFrame, entropy_col: str = "entropy", deviation_col: str = "deviation") -> DataFrame:
    """Information gain: the entropy where there are votes, else a quarter of the deviation."""
    return found.withColumn("score", F.coalesce(F.col(entropy_col), 0.25 * F.col(deviation_col), F.lit(0.0)))


def likely_resolved(votes: DataFrame, group: str = "entity", outcome: str = "outcome", rules: Rules = Rules()) -> DataFrame:
    """Unresolved groups that one more human vote for their leading outcome would resolve."""
    now = consensus(votes, group, outcome, rules).where("resolved is null")
    flag = {"human": True, "implicit": False, "privileged": False}
    more = now.select(group, F.col("winner").alias(outcome), F.lit(1.0).alias("weight"), *[F.lit(v).alias(k) for k, v in flag.items()])
    columns = [group, outcome, "weight", *flag]
    affected = votes.select(*columns).join(now.select(group), group, "left_semi")
    return consensus(affected.unionByName(more.select(*columns)), group, outcome, rules).where("resolved is not null").select(group, F.col("resolved").alias("would_be"))


def tag_status(votes: DataFrame, group: list[str], rules: Rules = Rules(), sensitive: Column | None = None) -> DataFrame:
    """Five-way status of (entity, tag) from polarities: PENDING, RESOLVED_APPLY, RESOLVED_REJECT, CONTESTED (humans disagree) or UNRESOLVED."""
    keyed = votes.withColumn("__g", F.struct(*group)).withColumn("__o", F.when(F.col("polarity") > 0, 1).otherwise(-1))
    found = consensus(keyed, "__g", "__o", rules)
    split = keyed.groupBy("__g").agg((F.countDistinct(F.when(F.col("human"), F.col("__o"))) > 1).alias("split"), F.max("privileged").alias("any_privileged"))
    gate = sensitive if sensitive is not None else F.lit(False)
    status = (
        F.when(F.col("resolved").isNotNull() & gate & ~F.col("won_privileged"), "PENDING")
        .when(F.col("resolved") == "1", "RESOLVED_APPLY")
        .when(F.col("resolved") == "-1", "RESOLVED_REJECT")
        .when(F.col("split"), "CONTESTED")
        .otherwise("UNRESOLVED")
    )
    won = keyed.groupBy("__g", F.col("__o").alias("winner")).agg(F.max("privileged").alias("won_privileged"))
    return found.join(split, "__g").join(won, ["__g", "winner"]).select("__g.*", status.alias("status"))


def outcome_status(votes: DataFrame, group: str = "entity", outcome: str = "outcome", unknown: str = "UNKNOWN", rules: Rules = Rules()) -> DataFrame:
    """RESOLVED, UNKNOWN (the sentinel won), CONTESTED (more than one distinct outcome) or UNRESOLVED."""
    found = consensus(votes, group, outcome, rules)
    n = votes.groupBy(group).agg(F.countDistinct(F.coalesce(F.col(outcome), F.lit(unknown))).alias("n"))
    status = F.when(F.col("resolved") == unknown, "UNKNOWN").when(F.col("resolved").isNotNull(), "RESOLVED").when(F.col("n") > 1, "CONTESTED").otherwise("UNRESOLVED")
    return found.join(n, group).select(group, "resolved", status.alias("status"))


def merged_tags(cards: DataFrame, statuses: DataFrame, key: str, tags: str = "tags") -> DataFrame:
    """cards with tags of RESOLVED_APPLY added and of RESOLVED_REJECT removed; arrays stay sorted."""
    sets = statuses.groupBy(key).agg(F.collect_set(F.when(F.col("status") == "RESOLVED_APPLY", F.col("tag"))).alias("plus"), F.collect_set(F.when(F.col("status") == "RESOLVED_REJECT", F.col("tag"))).alias("minus"))
    none = F.array().cast("array<string>")
    new = F.array_sort(F.array_except(F.array_union(F.col(tags), F.coalesce("plus", none)), F.coalesce("minus", none)))
    return cards.join(sets, key, "left").withColumn(tags, new).drop("plus", "minus")


def transitions(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts by (before, after) of the column status; a missing side is null."""
    b, a = before.select(key, F.col("status").alias("before")), after.select(key, F.col("status").alias("after"))
    return b.join(a, key, "full").groupBy("before", "after").agg(F.count("*").alias("n"))
