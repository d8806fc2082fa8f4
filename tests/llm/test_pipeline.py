"""Each stage of the pipeline against brute force on what its predecessor kept."""

from collections import defaultdict

import corpus_pipeline as P
from lodeframe.llm import substring_dedup, toxicity

from .helpers import components, docs
from .test_decontamination import brute as brute_hits
from .test_substring_dedup import brute as brute_cut

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_in_turn(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    raw = read("documents")

    clean = P.drop_toxic(spark, raw, SF).persist()
    scores = {r.doc_id: r.predicted for r in toxicity.scored(raw, read("labels")).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, p in scores.items() if not p)

    near = P.drop_near_copies(spark, clean, SF).persist()
    groups = components(rows_of(clean), 5, 80, 100)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in groups.items() if c == i)

    cut = P.cut_repeats(spark, near, SF).persist()
    want = brute_cut(rows_of(near), substring_dedup.WHOLE)
    assert {r.doc_id: r.text for r in cut.collect()} == {i: t for i, (_, _, t) in want.items()}
    assert all(r.n_chars == len(r.text) for r in cut.collect() if want[r.doc_id][1])

    kept = P.drop_contaminated(spark, cut, SF).persist()
    hits = brute_hits(rows_of(cut), [(r.item_id, r.text) for r in read("benchmark").collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(h[0] for h in hits if not h[-1])

    packed = P.pack(spark, kept, SF).collect()
    words = defaultdict(int)
    for r in packed:
        words[r.doc_id] += r.n_words
    assert dict(words) == {i: n for i, t in rows_of(kept) if (n := len(t.split(" ") and t.split()))}
    for df in (clean, near, cut, kept):
        assert df.columns == raw.columns and df.schema == raw.schema

    assert sorted(map(tuple, P.run(spark, SF).select("doc_id", "piece", "n_words").collect())) == sorted((r.doc_id, r.piece, r.n_words) for r in packed)


def test_empty_and_null_documents(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    rows = docs(spark, [(1, None), (2, ""), (None, "some words here"), (3, "a b"), (3, "a b")]).select("doc_id", "text", "lang", "source", "n_chars")
    rows.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id is None, r.n_words) for r in P.run(spark, str(tmp_path)).collect()) == [(False, 2), (True, 3)]


def test_clashing_columns_and_a_very_long_text(spark, tmp_path):
    """Extra columns named as those that stages use inside keep their values until the last stage."""
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(100_000))
    rows = docs(spark, [(1, long), (2, long), (3, "a clean text of a few words"), (4, None), (5, None)])
    extra = ["n_sentences", "n_removed", "d", "t", "places", "key", "hit_id", "hit_key", "label", "stays", "spans", "n"]
    rows = rows.selectExpr("*", *(f"concat('{c}', doc_id) as {c}" for c in extra))
    for _, stage in P.STAGES[:-1]:
        rows = stage(spark, rows, SF).persist()
        assert rows.columns[-len(extra) :] == extra
    assert {r.doc_id for r in rows.collect()} == {1, 3, 4, 5} and all(r[c] == f"{c}{r.doc_id}" for r in rows.collect() for c in extra)
    packed = P.pack(spark, rows, SF).collect()
    assert sum(r.n_words for r in packed if r.doc_id == 1) == 100_000 and {r.doc_id for r in packed} == {1, 3}
