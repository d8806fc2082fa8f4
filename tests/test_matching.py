import random

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import clustering as G
from lodeframe.operators import matching as M
from lodeframe.operators import search as S
from lodeframe.session import checkpointed


def test_hamming_pairs_against_brute_force(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    values = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base] + [-1, 0, 1, -2, base[0]]
    rows = list(enumerate(values))
    for d in (0, 1, 2, 3):
        pairs, members = M.near_groups(spark.createDataFrame(rows, "k int, h long"), "k", "h", d)
        stands = {v: min(i for i, x in rows if x == v) for _, v in rows}
        assert {r.k: r.representative for r in members.collect()} == {i: stands[v] for i, v in rows}
        want = {(min(stands[a], stands[b]), max(stands[a], stands[b]), n) for a in stands for b in stands if a != b and (n := ((a ^ b) & (2**64 - 1)).bit_count()) <= d}
        assert {tuple(r) for r in pairs.collect()} == want


def test_null_hashes_never_match(spark):
    pairs, members = M.near_groups(spark.createDataFrame([(1, None), (2, None)], "k int, h long"), "k", "h", 2)
    assert pairs.count() == members.count() == 0


def test_one_hash_of_most_rows_costs_a_row_each(spark):
    df = spark.range(20_000).selectExpr("id as k", "case when id % 3 = 0 then id else 5 end as h")
    pairs, members = M.near_groups(df.where("k < 20000"), "k", "h", 0)
    assert pairs.count() == 0 and members.count() == 20_000


def test_clear_winner(spark):
    rows = [(1, "a", 3), (1, "b", 20), (2, "a", 3), (2, "b", 5), (3, "a", 30), (4, "z", 8)]
    got = {r.r: (r.winner, r.reason) for r in M.clear_winner(spark.createDataFrame(rows, "r int, c string, d int"), "r", "c", "d", 10, 5).collect()}
    assert got == {1: ("a", ""), 2: (None, "margin-miss"), 3: (None, "distance-miss"), 4: ("z", "")}


def test_identity_groups_ignore_null_and_empty(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "x", None), (3, "", 5), (4, None, None), (5, "x", 5)], "k int, m string, h long")
    got = {tuple(r) for r in M.identity_groups(df, "k", "m", "h").collect()}
    assert got == {(1, 4, 1), (2, 3, 1), (3, 3, 1), (4, 1, 4), (5, 4, 1)}  # one hop: 2 and 3 are not linked
    chosen = lambda *keys: spark.createDataFrame([(x,) for x in keys], "k int")
    widened = lambda *keys: {r.k for r in M.widened(df, "k", ["m", "h"], chosen(*keys)).collect()}
    assert widened(2) == {1, 2, 5} and widened(3) == {1, 3, 5} and widened(4) == {4} and widened(99) == set()


def test_survivors(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([1, 2], None), (None, None), ([1], [2])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(M.surviving([F.col("a"), F.col("b")])).collect()] == [[2], [1, 2], None, []]


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    nodes = [(i, rng.randrange(60) if rng.random() < 0.7 else None, rng.randrange(60)) for i in range(120)]
    df = spark.createDataFrame(nodes, "k int, a int, b int")
    got = {r.k: r.component for r in G.components(df, G.shared_value_edges(df, "k", [F.col("a"), F.col("b")]), "k", checkpointed).collect()}
    label = {i: i for i, _, _ in nodes}
    changed = True
    while changed:
        changed = False
        for x in nodes:
            for y in nodes:
                if (x[1] is not None and x[1] == y[1] or x[2] == y[2]) and label[x[0]] < label[y[0]]:
                    label[y[0]] = label[x[0]]
                    changed = True
    assert got == label


def test_ancestors_of_a_long_chain_and_a_cycle(spark):
    rows = [(i, i - 1 if i else None) for i in range(1001)] + [(2000, 2000)]
    got = G.ancestors(spark.createDataFrame(rows, "k int, p int"), "k", "p").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {**{i: i + 1 for i in range(1001)}, 2000: 1}
    with pytest.raises(ValueError, match="cycle"):
        G.ancestors(spark.createDataFrame([(100, 101), (101, 102), (102, 100), (1, 100)], "k int, p int"), "k", "p")


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(100)], "k int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(99)], "a int, b int")
    assert {r.component for r in G.components(nodes, edges, "k", checkpointed).collect()} == {0}


def test_sums_of_stretches_equal_plain_sums(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 9)) for i in rng.sample(range(5000), 600)]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    got = S.rolling_sum(S.running_sum(df, ["g"], "k", F.col("v"), "total", stretch=64), ["g"], "k", F.col("v"), 7, "last")
    own = {g: sorted((k, v) for k, x, v in rows if x == g) for g in {"a", "b", None}}
    want = {k: (sum(v for _, v in of[: i + 1]), sum(v for _, v in of[max(0, i - 6) : i + 1])) for of in own.values() for i, (k, _) in enumerate(of)}
    assert {r.k: (r.total, r["last"]) for r in got.collect()} == want


def test_tiers_and_prefixes(spark):
    index = spark.createDataFrame([("red ring",), ("red ringer",), ("blue bolt",)], "name string")
    rows = spark.createDataFrame([(1, "red ring"), (2, "blue"), (3, "red r"), (4, "zzz")], "k int, t string")
    got = {r.k: r.name for r in M.unique_prefix(rows, "k", "t", index, "name").collect()}
    assert got == {1: "red ring", 2: "blue bolt"}


def test_review_clusters_over_three_signals_and_textual_keys(spark):
    rows = [("k1", 1, "a", None), ("k2", 1, None, "t"), ("k3", 2, None, "t"), ("k4", 2, "b", None), ("j1", 3, "c", "u"), ("j2", 3, "c", "u"), ("x", 9, None, None), ("y", None, "z", None), ("z", None, None, None)]
    df = spark.createDataFrame(rows, "k string, h int, s string, t string")
    members, clusters = G.review_clusters(df, "k", {"h": F.col("h"), "s": F.col("s"), "t": F.col("t")})
    assert {r.k: r.cluster for r in members.collect()} == {"k1": "k1", "k2": "k1", "k3": "k1", "k4": "k1", "j1": "j1", "j2": "j1"}
    assert sorted(map(tuple, clusters.collect())) == [("j1", 2, 1, 1, 1), ("k1", 4, 2, 0, 1)]
    none = G.review_clusters(df.limit(0), "k", {"h": F.col("h")})
    assert none[0].count() == 0 == none[1].count()


def test_components_of_chains_and_textual_keys(spark):
    rng = random.Random(3)
    names = [f"n{rng.randrange(10**9):09d}" for _ in range(60)]
    chain = [(names[i], names[i + 1]) for i in range(59) if i % 20 != 19]
    out = G.components(spark.createDataFrame([(n,) for n in names], "k string"), spark.createDataFrame(chain, "a string, b string"), "k")
    assert {r.k: r.component for r in out.collect()} == {n: min(names[20 * (i // 20) : 20 * (i // 20) + 20]) for i, n in enumerate(names)}


def test_sparse_keys_are_cut_as_dense_ones(spark):
    rng = random.Random(8)
    keys = rng.sample(range(-(10**12), 10**12), 900) + list(range(100))
    df = spark.createDataFrame([(k, rng.choice("aab"), rng.randrange(9)) for k in keys], "k long, g string, v int")
    sizes = [r["count"] for r in S.stretched(df, "k", 64).groupBy("stretch_").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 160  # not a stretch a row, nor one for all
    total, want = {}, {}
    for r in sorted(df.collect()):
        total[r.g] = total.get(r.g, 0) + r.v
        want[r.k] = total[r.g]
    for stretch in (64, 10**6):
        assert {r.k: r.s for r in S.running_sum(df, ["g"], "k", F.col("v"), "s", stretch).collect()} == want
    assert S.running_sum(df.limit(0), ["g"], "k", F.col("v"), "s").count() == 0


def test_survivors_by_counts(spark):
    printings = [("a", 1, "black", "x"), ("a", 2, "black", "y"), ("a", 3, "white", "x"), ("b", 4, None, "x"), ("b", 5, "black", None)]
    rows = [(1, "a", "black", ""), (2, "a", "black", "x"), (3, "a", "", None), (4, "a", "red", ""), (5, "a", "white", "x"), (6, "b", "black", "x"), (7, "b", "", "x"), (8, "c", "black", "x"), (9, "a", "white", "y"), (10, None, "white", "y")]
    out = M.surviving_counts(spark.createDataFrame(rows, "k int, name string, border string, artist string"), "k", "name", spark.createDataFrame(printings, "name string, pk int, border string, artist string"), "pk", ["border", "artist"])
    assert {r.k: (r.n, r.match, r.n_read) for r in out.collect()} == {1: (2, None, 1), 2: (1, 1, 2), 3: (None, None, 0), 4: (0, None, 1), 5: (1, 3, 2), 6: (0, None, 2), 7: (1, 4, 1), 9: (0, None, 2)}


@pytest.mark.parametrize("values", [[5], [5, 5, 7], [k << 20 for k in range(40)], [-1, -2, -9, 2**62, -(2**63), 2**63 - 1], [1 << k for k in range(63)], [3, 2**40 + 3, 2**40 + 2, 2]])
def test_bands_of_few_varying_bits_lose_no_pair(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "h long")
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    for d in (0, 2, 4):
        found = {(r.a, r.b): r.distance for r in M.near_values(df, df, d).collect()}
        assert found == {(a, b): bits(a, b) for a in set(values) for b in set(values) if bits(a, b) <= d}
    assert M.near_values(df.limit(0), df.limit(0), 2).count() == 0
