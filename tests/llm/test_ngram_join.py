import random

import pytest

from lodeframe.llm import ngram_join as J
from lodeframe.llm.components import connected_components

from .helpers import components, docs, shingle_set

SF = "/root/testdata/sf0.001"


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=1, groups=14, noise=40):
    """Groups of near copies of many sizes, a passage that many share, exact copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    rows = []
    for g in range(groups):
        base = [word() + word() for _ in range(rng.choice([6, 9, 20, 45, 90, 300]))]
        rows += [edited(rng, base, rng.randint(0, 1 + len(base) // 60)) for _ in range(rng.randint(1, 9))]
    passage = " ".join(word() for _ in range(30))
    rows += [passage + " " + " ".join(word() + word() for _ in range(rng.randint(5, 60))) for _ in range(noise)]
    rows += ["", None, " \t ", "one", "one", "one two three", "One  TWO three", "é à", rows[0], rows[0]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    out = J.jaccard_components(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == components(rows, 4, 85, 100)


@pytest.mark.parametrize("boundary", [0, 10**6])
def test_light_and_heavy_ways_agree(spark, monkeypatch, boundary):
    monkeypatch.setattr(J, "boundary_of", lambda *_: boundary)
    rows = corpus(3)
    out = J.jaccard_components(docs(spark, rows), J.JaccardJoin(words=3, num=70, broadcast_rows=0)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == components(rows, 3, 70, 100)


@pytest.mark.parametrize("seed", [4, 5])
def test_long_lists_in_blocks_lose_no_link(spark, monkeypatch, seed):
    """Lists of any length go in blocks of few members."""
    monkeypatch.setattr(J, "boundary_of", lambda *_: 0)
    rows = corpus(seed, groups=10, noise=120)
    rule = J.JaccardJoin(words=3, num=70, heavy_entries=0, short=2, block=5)
    out = J.jaccard_components(docs(spark, rows), rule).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == components(rows, 3, 70, 100)


def test_very_common_sets_and_components(spark):
    base = " ".join(f"w{i}" for i in range(90))
    rows = [(i, base) for i in range(3000)] + [(3000 + i, f"{base} x{i}") for i in range(2500)] + [(9000 + i, f"other {i} text {i} of its own {i}") for i in range(50)]
    out = J.jaccard_components(docs(spark, rows)).groupBy("component_id").count().collect()
    assert {r[0]: r[1] for r in out} == {0: 5500, **{9000 + i: 1 for i in range(50)}}
    assert J.one_of_each(docs(spark, rows)).count() == 51


def test_a_very_long_text(spark):
    rng = random.Random(3)
    long = [f"{rng.randrange(10**9):x}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[100:])), (3, " ".join(long[::-1])), (4, "short text")]
    assert {r.doc_id: r.component_id for r in J.jaccard_components(docs(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_whole_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = J.run(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == components(rows, 4, 85, 100)


def test_null_ids_repeats_and_an_empty_table(spark):
    t = "a b c d e f g h i j"
    out = J.jaccard_components(docs(spark, [(None, t), (5, t), (5, t), (9, t), (None, ""), (None, "z y x w v u")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or -1) for r in out) == [(False, 5, 7, 5), (False, 5, 7, 5), (False, 9, 7, 5), (True, 0, 0, -1), (True, 0, 3, -1), (True, 0, 7, 5)]
    assert J.jaccard_components(docs(spark, [])).count() == 0


def test_one_of_each(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(7, t), (3, t), (4, t + " end"), (8, "else " * 9), (1, ""), (2, ""), (None, "x"), (6, "six"), (6, "six")]
    kept = J.one_of_each(docs(spark, rows))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 3), (False, 6), (False, 8), (True, 0)]
    assert kept.columns == docs(spark, []).columns


def test_one_of_each_of_null_and_repeated_ids(spark):
    t, u = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(None, t), (None, t + " end"), (None, u), (7, u), (7, "a clean text that is of its own"), (7, "and another one of the same id"), (None, None), (None, "")]
    kept = J.one_of_each(docs(spark, rows)).collect()
    texts = sorted((r.doc_id is None, r.text or "") for r in kept)
    assert len(kept) == 6 and [x for x in texts if not x[0]] == [(False, "a clean text that is of its own"), (False, "and another one of the same id"), (False, u)]
    assert sum(r.text is not None and r.text.startswith("w0") for r in kept) == 1 and sum(not r.text for r in kept) == 2
    clash = docs(spark, [(1, t), (2, t)]).selectExpr("doc_id", "text", "3 as key", "4 as hit_id", "5 as stays", "6 as label")
    assert [tuple(r) for r in J.one_of_each(clash).collect()] == [(1, t, 3, 4, 5, 6)]
    assert J.one_of_each(docs(spark, [])).count() == 0


def test_connected_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (5, 4)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


def test_shingles_hash_like_words():
    import pyarrow as pa

    texts = ["A b\tC d e", "a B c\nd E ", "a", "", None, "\x00 x"]
    sets = J.shingle_sets(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), J.JaccardJoin())
    assert [len(s) for s in sets] == [len(shingle_set(t, 4)) for t in texts] and list(sets[0]) == list(sets[1])


def test_verified_links_are_named_so(spark):
    t = " ".join(f"w{i}" for i in range(50))
    out = J.jaccard_components(docs(spark, [(1, t), (2, t + " end"), (3, "other words " * 9)]))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_verified"]
    assert {r.doc_id: r.n_verified for r in out.collect()} == {1: 1, 2: 1, 3: 0}
