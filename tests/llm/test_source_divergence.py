import random
import re
from collections import Counter

import numpy as np
import pytest

from lodeframe.llm import source_divergence as D

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, part string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, "term", "part", 2) for i, (lang, source, t) in enumerate(rows)], SCHEMA)


def brute(rows, least=3, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(lang or "", source or "", terms(t)) for lang, source, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(t for r in own for t in set(r[2]))
        kept = [t for t, n in docs.items() if n >= least]
        counts = {}
        for _, source, ts in own:
            counts.setdefault(source, Counter()).update(t for t in ts if docs[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in p:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            found = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, values in (("pair", pairs), ("term", found)):
                ranked = sorted(values, key=lambda v: (-v[1], v[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(ranked[: top if part == "term" else None], 1)]
    return sorted(out)


def fixture():
    rng = random.Random(12)
    words = ["ab", "Ab", "é", "É", "日", "zz", "b1c", "d-e", "\U0001f600", "ﬀ", "y", "x", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for _ in range(300):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "S2", "é", None, "￮", "\U00010000"])
        rows.append((lang, source, rng.choice([" ", ",\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 25)))))
    rows += [("en", "empty", None), ("en", "empty", ""), ("xx", "a", "one two"), ("xx", "b", "three"), ("xx", None, None), ("yy", "alone", "q q q"), ("yy", "alone", "q"), ("yy", "alone", "q z")]
    return rows + rows[:40]


@pytest.mark.parametrize("options", [{}, {"top": 2}, {"cells": 16}, {"sums": 9}, {"groups_at_once": 2, "cells": 64, "least": 1}])
def test_rows_equal_brute_force(spark, options):
    rows = fixture()
    out = sorted(tuple(r) for r in D.divergence(table(spark, rows), **options).collect())
    assert out == brute(rows, **{k: v for k, v in options.items() if k in ("top", "least")})


def test_whole_small_table(spark):
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in D.run(spark, SF).collect()) == brute(rows)


def test_very_long_text_is_one_document(spark):
    long = "alpha beta " * 700_000 + "gamma " + "alpha " * 10
    rows = [("en", "a", long), ("en", "b", "alpha gamma"), ("en", "b", "alpha beta"), ("en", "c", "alpha alpha beta gamma")]
    assert sorted(tuple(r) for r in D.divergence(table(spark, rows)).collect()) == brute(rows)


def test_empty_table(spark):
    assert D.divergence(table(spark, [])).count() == 0


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for most in (10**6, 10**10, 10**14):
        counts = np.array([rng.randrange(most) for _ in range(50)])
        total = int(counts.sum()) + 50
        assert D.shares(counts, np.array(total)).tolist() == [1 + 10**9 * (c + 1) // total for c in counts.tolist()]
    assert D.tally(np.array([0, 1, 1]), np.array([2**60 + 1, 2**53 + 1, 2]), 3).tolist() == [2**60 + 1, 2**53 + 3, 0]
