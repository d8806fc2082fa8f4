import hashlib
import random

import pytest

from lodeframe.llm import decontamination as D

from .helpers import alnum, docs

SF = "/root/testdata/sf0.001"


def brute(rows, items, size=10):
    out = []
    for i, text in rows:
        w = alnum(text)
        hit, found = set(), set()
        for item, t in items:
            iw = alnum(t)
            k = min(size, len(iw))
            windows = {tuple(iw[j : j + k]) for j in range(len(iw) - k + 1)} if k else set()
            for j in range(len(w) - k + 1 if k else 0):
                if tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    if item is not None:
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(4)
    word = lambda: rng.choice(["Ab", "cd", "É", "x1", "the"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 30])))) for k in range(12)] + [(90, None), (91, "..."), (None, "nul id item"), (3, "again the"), (92, "q " * 25)]
    rows = [(i, ", ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(50, None), (51, ""), (52, "q " * 40), (53, items[5][1]), (53, items[5][1]), (None, items[0][1]), (54, "nul-ID. Item")]
    return rows, items


@pytest.mark.parametrize("bound", [10**6, 7])
def test_rows_equal_brute_force(spark, bound):
    rows, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = sorted((tuple(r) for r in D.contaminated_rows(docs(spark, rows), bench, bound=bound).collect()), key=str)
    assert out == brute(rows, items)
    hit = {(r[0], r[5]) for r in out}
    kept = D.clean_documents(docs(spark, rows), bench, bound=bound)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in out if not r[5]), key=str) and hit
    one = D.contamination(docs(spark, rows), bench).select("doc_id", "tkey", "places", "items")
    assert one.exceptAll(D.contamination(docs(spark, rows), bench, bound=bound).select("doc_id", "tkey", "places", "items")).count() == 0


def test_cut_texts_do_not_depend_on_parts(spark):
    rows, items = fixture()
    bench, table = spark.createDataFrame(items, "item_id long, text string"), docs(spark, rows)
    cuts = [D.without_spans(table, D.contamination(table, bench, bound=b)) for b in (10**6, 7)]
    assert cuts[0].columns == table.columns and cuts[0].exceptAll(cuts[1]).count() == 0
    assert all(not set(D.contaminated_rows(c, bench).where("n_hit > 0").select("doc_id").distinct().toPandas().doc_id) & {53.0} for c in cuts)


def test_clashing_columns_and_a_very_long_text(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    long = "word " * 2_000_000 + "one two three four five six seven eight nine ten " + "word " * 1000
    table = docs(spark, [(1, long), (2, "clean")]).selectExpr("doc_id", "text", "1 as key", "2 as places", "3 as spans", "4 as hit_key", "5 as Hit_ID", "6 as n_words")
    for bound in (10**6, 1):
        kept = D.clean_documents(table, bench, bound=bound)
        assert kept.columns == table.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", 1, 2, 3, 4, 5, 6)]
    cut = D.without_spans(table, D.contamination(table, bench))
    assert cut.columns == table.columns and {r.doc_id: len(r.text) for r in cut.collect()} == {1: len(long) - len("one two three four five six seven eight nine ten") + 1, 2: 5}


def test_whole_small_tables(spark):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()]
    assert sorted(map(tuple, D.run(spark, SF).collect()), key=str) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_spans_and_documents_are_removed(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = [(1, "Start: one, two three four five six seven eight nine TEN eleven. End é"), (2, "clean é"), (3, None)]
    found = D.contamination(docs(spark, rows), bench)
    cut = {r.doc_id: r.text for r in D.without_spans(docs(spark, rows), found).collect()}
    assert cut == {1: "Start:  . End é", 2: "clean é", 3: None}
    assert sorted(r.doc_id for r in D.clean_documents(docs(spark, rows), bench).collect()) == [2, 3]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    r = D.contaminated_rows(docs(spark, [(1, "a b")]), none).first()
    assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (2, 0, 0, D.NO_ITEMS, False)
    assert D.contaminated_rows(docs(spark, []), none).count() == 0
