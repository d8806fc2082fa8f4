"""Pairs of texts whose similarity can reach a threshold, by letter grams: nothing that reaches it is lost.

With a common subsequence of L letters two texts of n and m letters have the ratio 2L / (n + m), and no
ratio of matching blocks is greater.  A ratio of t or more leaves at most (1 - t)(n + m) letters outside.

* Single letters, counted: at least n t / (2 - t) of a text's n letters are in the other text.
* Pairs of letters, from t = ``PAIRED`` on: a letter outside spoils two pairs, so at least
  n (4t - 3) - 1 of a text's n - 1 pairs, and one, are in the other text.

Each text looks for partners by its rarest grams alone (rare in the lexicon), as many as must hold
one that is shared.  What meets is counted exactly, and only then compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From this threshold on pairs of letters tell more than letters.
PAIRED = 0.85
_EPS = 1e-9


def needed(n: Column | int, threshold: float) -> Column:
    """How many grams of a text of n letters any partner shares."""
    n = n if isinstance(n, Column) else F.lit(n)
    least = n * (4 * threshold - 3) - 1 if threshold >= PAIRED else n * threshold / (2 - threshold)
    return F.greatest(F.lit(1), F.ceil(least - _EPS).cast("int"))


def grams(c: Column, threshold: float) -> Column:
    """The grams of a text, each with how often it stood before, so that equal ones count apart."""
    size = 2 if threshold >= PAIRED else 1
    last = F.length(c) - size + 1
    plain = F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda k: F.substring(c, k, F.lit(size)))
    return F.transform(plain, lambda g, k: F.concat(g, F.lit(" "), F.size(F.filter(F.slice(plain, 1, k), lambda x: x == g)).cast("string")))


def _ranked(texts: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """(text, grams, gram): a row for each of the rarest grams of a text, of which a partner shares one."""
    listed = texts.select("text", grams(F.col("text"), threshold).alias("grams"))
    each = listed.select("text", F.explode("grams").alias("gram")).join(frequency, "gram", "left")
    ordered = each.groupBy("text").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))  # of one text
    kept = F.size("g") - needed(F.length("text"), threshold) + 1
    rare = F.transform(F.when(kept > 0, F.slice("g", F.lit(1), kept)).otherwise(F.slice("g", 1, 0)), lambda x: x["gram"])
    return ordered.select("text", F.transform("g", lambda x: x["gram"]).alias("grams"), F.explode(rare).alias("gram"))


def near_pairs(left: DataFrame, a: str, right: DataFrame, b: str, threshold: float) -> DataFrame:
    """(a, b) distinct texts of both sides that may reach the threshold: all that do are among them.

    Equal texts are always a pair, empty ones too; nulls are in none.  Grams that very many entries share
    are looked up only by texts that have few others.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and not above 1")
    one = left.select(F.col(a).alias("text")).where("text is not null").distinct()
    two = right.select(F.col(b).alias("text")).where("text is not null").distinct()
    frequency = two.select(F.explode(grams(F.col("text"), threshold)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    l = _ranked(one, frequency, threshold).select(F.col("text").alias("a_"), F.col("grams").alias("ga"), "gram")
    r = _ranked(two, frequency, threshold).select(F.col("text").alias("b_"), F.col("grams").alias("gb"), "gram")
    n, m = F.length("a_"), F.length("b_")
    fits = (F.least(n, m) * (2 - threshold) + _EPS >= F.greatest(n, m) * threshold) & (F.size(F.array_intersect("ga", "gb")) >= F.greatest(needed(n, threshold), needed(m, threshold)))
    met = l.join(r, "gram").where((F.col("a_") != F.col("b_")) & fits).select("a_", "b_").distinct()
    same = one.join(two, "text").select(F.col("text").alias("a_"), F.col("text").alias("b_"))
    return met.unionByName(same).select(F.col("a_").alias(a), F.col("b_").alias(b))
