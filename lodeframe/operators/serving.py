"""Which question to serve next: lanes of pooled cards, mixed by what a voter was served before.

A voter's next card comes from the likely lane while the share of likely cards among all they were
served is below the target and the lane has cards for them, else from the first other lane that
has.  Each draw goes into the served log and so moves the share that decides the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIKELY, OTHERS = "likely", ("confirm", "contested", "fresh")
# Fixed value: the share of likely cards that is aimed at.
TARGET = 0.51


def pooled(cards: DataFrame, key: str, lane: str, order: list, size: int = 500) -> DataFrame:
    """(lane, place, key): the first ``size`` cards of each lane, which the pools hold (a feature: pools are built ahead)."""
    place = F.row_number().over(Window.partitionBy(lane).orderBy(*order))
    return cards.withColumn("place", place).where(F.col("place") <= size).select(F.col(lane).alias("lane"), "place", F.col(key).alias("card"))


def drawn(voters: DataFrame, pool: DataFrame, excluded: DataFrame, log: DataFrame, draws: int, target: float = TARGET) -> DataFrame:
    """(voter, draw, lane, card, share): the next ``draws`` cards of each voter, as if each were answered when served.

    voters: (voter); pool: as ``pooled`` gives it; excluded: (voter, card) that a voter answered or
    hid; log: (voter, lane) of what was served before.  ``share`` is the share of likely cards when the
    draw was made (0 with an empty log).  A voter gets fewer rows when all lanes run out.  A lane's
    k-th card for a voter is found by counting the excluded places before it, so no voter is paired
    with a pool; a voter holds at most the pool's size of excluded places.
    """
    lanes = (LIKELY, *OTHERS)
    sizes = pool.groupBy("lane").agg(F.count("*").alias("n"))
    known = {r.lane: r.n for r in sizes.collect()}  # a row a lane
    gone = excluded.distinct().join(pool, "card").groupBy("voter").agg(*[F.array_sort(F.collect_set(F.when(F.col("lane") == lane, F.col("place")))).alias(f"gone_{lane}") for lane in lanes])
    before = log.groupBy("voter").agg(F.count("*").alias("total"), F.count_if(F.col("lane") == LIKELY).alias("likely"))
    rows = voters.select("voter").distinct().join(gone, "voter", "left").join(before, "voter", "left")
    none = F.array().cast("array<int>")
    left = {lane: F.lit(known.get(lane, 0)) - F.size(F.coalesce(f"gone_{lane}", none)) for lane in lanes}
    start = F.struct(F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("likely", F.lit(0)).cast("long").alias("likely"), *[F.lit(0).alias(f"n_{lane}") for lane in lanes], F.array().cast("array<struct<draw int, lane string, k int, share double>>").alias("served"))
    rows = rows.select("voter", *[F.coalesce(f"gone_{lane}", none).alias(f"gone_{lane}") for lane in lanes], *[left[lane].alias(f"left_{lane}") for lane in lanes], start.alias("start"))

    def step(s, draw):
        share = F.when(s["total"] > 0, s["likely"] / s["total"]).otherwise(F.lit(0.0))
        has = lambda lane: s[f"n_{lane}"] < F.col(f"left_{lane}")
        lane = F.when((share < target) & has(LIKELY), LIKELY)
        for other in OTHERS:
            lane = lane.when(has(other), other)
        return F.struct(s.alias("s"), share.alias("share"), lane.alias("lane"), draw.alias("draw"))

    def moved(x):
        s, lane = x["s"], x["lane"]
        k = sum((F.when(lane == name, s[f"n_{name}"] + 1).otherwise(0) for name in lanes[1:]), F.when(lane == lanes[0], s[f"n_{lanes[0]}"] + 1).otherwise(0))
        entry = F.struct(x["draw"].alias("draw"), lane.alias("lane"), k.cast("int").alias("k"), x["share"].cast("double").alias("share"))
        served = F.when(lane.isNotNull(), F.concat(s["served"], F.array(entry))).otherwise(s["served"])
        one = F.when(lane.isNotNull(), 1).otherwise(0)
        return F.struct((s["total"] + one).alias("total"), (s["likely"] + F.when(lane == LIKELY, 1).otherwise(0)).alias("likely"), *[(s[f"n_{name}"] + F.when(lane == name, 1).otherwise(0)).cast("int").alias(f"n_{name}") for name in lanes], served.alias("served"))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.col("start"), lambda s, draw: F.aggregate(F.array(step(s, draw)), s, lambda _, x: moved(x)))
    served = rows.select("voter", *[f"gone_{lane}" for lane in lanes], F.explode(folded["served"]).alias("d")).select("voter", *[f"gone_{lane}" for lane in lanes], "d.*")
    own = F.when(F.col("lane") == lanes[0], F.col(f"gone_{lanes[0]}"))
    for lane in lanes[1:]:
        own = own.when(F.col("lane") == lane, F.col(f"gone_{lane}"))
    # The k-th place that is left lies behind the j-th gone place a if fewer than k are left before it: a - j < k.
    skipped = F.size(F.filter(F.transform(own, lambda a, j: a - (j + 1)), lambda free: free < F.col("k")))
    placed = served.select("voter", "draw", "lane", "share", (F.col("k") + skipped).alias("place"))
    return placed.join(pool, ["lane", "place"]).select("voter", "draw", "lane", "card", "share")
