"""The consensus scenarios, pooling, gates, and a random comparison with plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import consensus as C

# (case, votes by outcome in units U human 1, U5 human 5, M machine 0.5, F non-human 1, expected)
CASES = [
    ("A1", {"X": "U"}, None), ("A2", {"X": "UU"}, "X"), ("A3", {"X": "UUU"}, "X"), ("A4", {"X": "5"}, "X"), ("A5", {"X": "5", "Y": "U"}, "X"),
    ("A6", {"X": "U", "Y": "U"}, None), ("A7", {"X": "UU", "Y": "U"}, "X"), ("A8", {"X": "UUU", "Y": "UU"}, "X"), ("A9", {"X": "UU", "Y": "UU"}, None),
    ("A10", {"X": "MM"}, None), ("A11", {"X": "M" * 100}, None), ("A12", {"X": "MMMMU"}, "X"), ("A13", {"X": "U", "Y": "MMMM"}, None),
    ("A14", {"A": "UMMMM", "B": "U"}, None), ("A19", {"X": "F"}, None), ("A20", {"X": "FF"}, None), ("A21", {"X": "FU"}, "X"),
    ("B1", {"A": "UUMMM"}, "A"), ("B2", {"A": "UMMM"}, "A"), ("B3", {"A": "U", "B": "MMM"}, None), ("B4", {"A": "UU", "B": "MMM"}, "A"), ("B5", {"A": "UU", "B": "M"}, "A"),
]
UNIT = {"U": (1.0, True), "5": (5.0, True), "M": (0.5, False), "F": (1.0, False)}
SCHEMA = "entity string, outcome string, agent string, weight double, human boolean, implicit boolean, privileged boolean"


def test_scenarios(spark):
    rows = [(case, o, None, *UNIT[u], False, False) for case, votes, _ in CASES for o, units in votes.items() for u in units]
    got = {r.entity: r.resolved for r in C.consensus(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {case: want for case, _, want in CASES}


@pytest.mark.parametrize("privileged, want", [(True, "X"), (False, C.PENDING)])
def test_gate(spark, privileged, want):
    rows = [("e", "X", None, 1.0, True, False, privileged)] * 2
    assert C.consensus(spark.createDataFrame(rows, SCHEMA), gated=True).first().resolved == want


def test_implicit_cap(spark):
    rows = [("e", "X", None, 1.0, True, False, False)] + [("e", "Y", None, 0.25, False, True, False)] * 40
    r = C.consensus(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.winner, r.weight, r.resolved) == ("X", 1.0, None)


def test_pooling(spark):
    rows = [
        ("e", "X", "calc-v1", 0.5, False, False, False), ("e", "X", "calc-v2", 1.0, False, False, False),  # one family: the heavier stays
        ("e", "X", "u1", 1.0, True, False, False), ("e", "Y", "u1", 1.0, True, False, False),  # contradicts itself: dropped
        ("e", "Y", None, 1.0, True, False, False), ("e", "Y", None, 1.0, True, False, False),  # no agent: passes
    ]
    got = sorted(tuple(r) for r in C.pooled(spark.createDataFrame(rows, SCHEMA)).select("outcome", "weight", "human").collect())
    assert got == [("X", 1.0, False), ("Y", 1.0, True), ("Y", 1.0, True)]


def test_frozen_cohort_and_privilege(spark):
    rules = C.Rules(frozen=(("calc", "r1"),))
    rows = [("deduction", "calc-v3", "r1", False, 0.0), ("deduction", "calc-v3", "r2", False, 0.5), ("user", "u", None, True, 5.0), ("implicit", "u", None, False, 0.25)]
    df = spark.createDataFrame(rows, "source string, agent string, run_id string, p boolean, want double")
    out = df.select("want", C.vote_weight(F.col("source"), F.col("agent"), F.col("run_id"), F.col("p"), rules).alias("w")).collect()
    assert all(r.w == r.want for r in out)


def naive(votes, rules=C.Rules()):
    by = defaultdict(lambda: [0.0, 0.0, 0.0, False])
    for _, o, _, w, human, implicit, _ in votes:
        by[o][0 if human else 2 if implicit else 1] += w
        by[o][3] |= human
    full = {o: h + min(m, 1) + min(s, 1) for o, (h, m, s, _) in by.items()}
    human = {o: v[0] for o, v in by.items()}
    only = sum(v[3] for v in by.values()) >= 2 or max(human.values()) >= rules.least_weight
    d = human if only else full
    best = min(d, key=lambda o: (-d[o], o))
    total = sum(d.values())
    return best if d[best] >= 2 and total and d[best] / total >= 0.6 and by[best][3] else None


def test_random_against_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for e in range(300):
        for _ in range(rng.randint(1, 9)):
            kind = rng.choice("U5MFI")
            w, h = UNIT.get(kind, (0.25, False))
            rows.append((str(e), rng.choice("XYZ"), None, w, h, kind == "I", False))
    got = {r.entity: r.resolved for r in C.consensus(spark.createDataFrame(rows, SCHEMA)).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert got == {e: naive(v) for e, v in by.items()}


def test_statuses(spark):
    rows = [(1, 7, 1, 5.0, True, False, True), (2, 7, -1, 5.0, True, False, False), (3, 7, 1, 1.0, True, False, False), (3, 7, -1, 1.0, True, False, False), (4, 7, 1, 0.5, False, False, False)]
    df = spark.createDataFrame(rows, "e int, t int, polarity int, weight double, human boolean, implicit boolean, privileged boolean")
    got = {r.e: r.status for r in C.tag_status(df, ["e", "t"], sensitive=F.lit(True)).collect()}
    assert got == {1: "RESOLVED_APPLY", 2: "PENDING", 3: "CONTESTED", 4: "UNRESOLVED"}
