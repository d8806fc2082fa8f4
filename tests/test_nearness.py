"""Pairs of near texts: none that reaches the threshold is lost, few others are compared."""

import random

import pytest
from difflib import SequenceMatcher
from pyspark.sql import functions as F

from lodeframe.functions.similarity import indel_ratio
from lodeframe.operators import best as B
from lodeframe.operators import naming as N
from lodeframe.operators import nearness as P


def texts(rng, n):
    """Words with letters left out, put in, swapped and misread, both ends among them."""
    base = ["".join(rng.choice("abcdeéz ") for _ in range(rng.randint(0, 14))) for _ in range(n // 4)]
    out = list(base)
    while len(out) < n:
        w = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "a", "é"])
        out.append("".join(w))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.79, 0.85, 0.92, 1.0])
def test_nothing_is_lost(spark, threshold):
    rng = random.Random(int(threshold * 100))
    one, two = texts(rng, 150), [*texts(rng, 150), "aaaaaaaaaaaa", "aaaaaaaaaaab", "", "é"]
    two += one[:30]
    l, r = spark.createDataFrame([(x,) for x in one + [None]], "a string"), spark.createDataFrame([(x,) for x in two + [None]], "b string")
    found = {(p.a, p.b) for p in P.near_pairs(l, "a", r, "b", threshold).collect()}
    wanted = {(a, b) for a in set(one) for b in set(two) if indel_ratio(a, b) >= threshold}
    assert wanted <= found and wanted
    assert found <= {(a, b) for a in one for b in two} and len(found) == P.near_pairs(l, "a", r, "b", threshold).count()


def test_few_others_are_compared(spark):
    """Candidates grow with the texts, not with their product."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(10, 18)))
    words = sorted({word() for _ in range(2000)})
    misread = [(w[:3] + "#" + w[4:],) for w in words]
    l, r = spark.createDataFrame(misread, "a string"), spark.createDataFrame([(w,) for w in words], "b string")
    pairs = P.near_pairs(l, "a", r, "b", 0.85)
    assert len(words) <= pairs.count() <= 1.2 * len(words)


def test_readings_equal_all_pairs(spark):
    rng = random.Random(2)
    lexicon = sorted({" ".join(rng.choice(["ann", "bob", "carla", "dirk", "emmanuel"]) + rng.choice(["", "son", "sen", "a"]) for _ in range(2)) for _ in range(40)})
    lines = []
    for k in range(60):
        name = list(rng.choice(lexicon).title())
        if k % 3 == 0:
            name[0], name[-1] = "X", "q"  # misread at both ends
        if k % 3 == 1:
            name.insert(rng.randrange(len(name)), "i")
        lines.append((k, f"012/250 C {''.join(name)} TM"))
    letters = lambda s: "".join(c for c in s.lower() if "a" <= c <= "z")

    def plain(line):
        words, ratios = [w for w in line.replace("/", " ").split() if any(c.isalpha() for c in w)], {}
        windows = {letters("".join(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1)}
        for w in windows:
            for e in lexicon:
                if len(w) >= 3 and SequenceMatcher(None, w, letters(e)).ratio() >= N.READING:
                    ratios[e] = max(ratios.get(e, 0), SequenceMatcher(None, w, letters(e)).ratio())
                begun = [x for x in lexicon if letters(x).startswith(w) and len(letters(x)) > max(N.CUT_LETTERS, len(w))]
                if len(w) >= N.CUT_LETTERS and e in begun and len(begun) <= N.COMPATIBLE:
                    ratios[e] = max(ratios.get(e, 0), N.READING)
        top = sorted(((r, e) for e, r in ratios.items()), reverse=True)
        return top[0][1] if top and (len(top) == 1 or top[0][0] - top[1][0] >= 0.05) else None

    df = spark.createDataFrame(lines, "k int, line string")
    names = spark.createDataFrame([(n,) for n in lexicon], "name string")
    found = {r.k: r.entry for r in N.recovered(df, "k", "line", names, "name").collect()}
    assert found == {k: plain(line) for k, line in lines if plain(line)} and any(k % 3 == 0 for k in found)


def test_recognised_equals_all_pairs(spark):
    rng = random.Random(3)
    lexicon = sorted(set(texts(rng, 80)) - {""})
    reads = sorted({*texts(rng, 60), *(w.replace("a", "e") for w in lexicon)})
    want = {}
    for t in reads:
        scored = sorted(((-indel_ratio(t, e), e) for e in lexicon))
        hi, lo = -scored[0][0], -scored[1][0]
        if hi >= N.READING and hi - lo >= N.MARGIN - 1e-9:
            want[t] = scored[0][1]
    out = N.recognised(spark.createDataFrame([(t,) for t in reads], "t string"), "t", spark.createDataFrame([(e,) for e in lexicon], "e string"), "e")
    assert {r.t: r.e for r in out.collect()} == want and want


def test_suggestions_equal_all_pairs(spark):
    rng = random.Random(4)
    tags = [(k, t, [t + "s"]) for k, t in enumerate(sorted({x.strip() for x in texts(rng, 40)} - {""}))]
    raws = [x for x in texts(rng, 60) if x.strip()]
    known = {x.lower() for _, n, a in tags for x in (n, *a)}
    clean = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in {*raws, *(y for _, n, a in tags for y in (n, *a))}], "x string").select("x", N.T.searchable(F.col("x"))).collect()}
    want = {}
    for raw in set(raws):
        if raw.lower() in known or not clean[raw]:
            continue
        ratio, less = max((indel_ratio(clean[raw], clean[x]), -pk) for pk, n, a in tags for x in (n, *a))
        if ratio >= N.SUGGESTION:
            want[raw] = (-less, ratio, raws.count(raw))
    stored = spark.createDataFrame([], "raw string, tag_pk long, ratio double, occurrences long, status string")
    out = N.suggested(spark.createDataFrame([(x,) for x in raws], "raw string"), spark.createDataFrame(tags, "pk long, name string, aliases array<string>"), stored)
    assert {r.raw: (r.tag_pk, r.ratio, r.occurrences) for r in out.collect()} == want


@pytest.mark.parametrize("threshold", [0.3, 0.79, 0.95, 1.0])
def test_best_entries_equal_all_pairs(spark, monkeypatch, threshold):
    """The two best of each text, over several blocks and steps of few cells."""
    monkeypatch.setattr(B, "TEXTS", 40)
    monkeypatch.setattr(B, "ENTRIES", 30)
    rng = random.Random(5)
    one, two = sorted({*texts(rng, 100), "é" * 70}), sorted({*texts(rng, 100), "é" * 72, "a\0", "a"})
    l, r = spark.createDataFrame([(x,) for x in [*one, None]], "t string"), spark.createDataFrame([(x,) for x in [*two, None]], "e string")
    want = {(t, e, indel_ratio(t, e)) for t in one for e in sorted(two, key=lambda e: (-indel_ratio(t, e), e))[:2] if indel_ratio(t, e) >= threshold}
    assert {tuple(x) for x in B.best_entries(l, "t", r, "e", threshold).collect()} == want and want
    monkeypatch.setattr(B, "CELLS", 64)
    tree = B.Tree(two)
    found = [(one[i], two[j], z) for x in B.walked(one, tree, threshold) for i, j, z in zip(*x, strict=True)]
    assert sorted(found) == sorted((t, e, indel_ratio(t, e)) for t in one for e in two if indel_ratio(t, e) >= threshold)


def test_candidates_of_numbered_names_stay_few(spark, monkeypatch):
    """Names that differ in a number have very many near ones; rows made are two a text at most, however many these are."""
    made = []
    few = B.best_entries
    monkeypatch.setattr(N, "best_entries", lambda *a, **k: made.append((a[0].distinct().count(), few(*a, **k))) or made[-1][1])
    names = [(f"red ring {k:04d}".translate(str.maketrans("0123456789", "abcdefghij")),) for k in range(0, 6400, 8)]
    df = spark.createDataFrame(names, "e string")
    N.recognised(df.select(F.regexp_replace("e", "n", "m").alias("t")), "t", df, "e").count()
    assert made and all(found.count() <= 2 * n for n, found in made)


def test_tags_that_read_alike_are_one_candidate(spark):
    """Digits are no part of a searchable text: all tags here have one, and the smallest pk of them wins."""
    tags = spark.range(5, 3005).selectExpr("id as pk", "concat('tag', id) as name", "array(concat('label tag', id)) as aliases")
    stored = spark.createDataFrame([], "raw string, tag_pk long, ratio double, occurrences long, status string")
    out = N.suggested(spark.createDataFrame([("tagg1",), ("labl tag",), ("tagg1",)], "raw string"), tags, stored)
    assert {(r.raw, r.tag_pk, r.occurrences) for r in out.collect()} == {("tagg1", 5, 2), ("labl tag", 5, 1)}
