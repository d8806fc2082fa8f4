import math
import random
import re

from lodeframe.llm import license_scan as L

from .helpers import alnum, docs

SF = "/root/testdata/sf0.001"


def brute(text, templates=L.TEMPLATES, phrases=L.PHRASES, threshold=0.9, slack=2):
    """n_words, places and, for each template, (label, first place, containment) of every window that meets it."""
    w = alnum(text)
    places = sorted((label, i) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    met = []
    for label, t in templates:
        own = alnum(t)
        wanted = set(own)
        need = math.ceil(round(threshold * len(wanted), 9))
        for i in range(len(w)):
            held = wanted & set(w[i : i + slack * len(own)])
            if w[i] in wanted and len(held) >= need:
                met.append((label, i, len(held) / len(wanted)))
    return len(w), places, met


def agrees(row, text, score, **options):
    n, places, met = brute(text, **options)
    assert row.n_words == n and sorted((p.label, p.first_word) for p in row.places) == places
    assert {b.label for b in row.blocks} == {m[0] for m in met}
    for label, at, share in met:  # every window is in a block, and no block is better than its best window
        assert any(b.label == label and b.first_word <= at <= b.last_word and b.containment >= share for b in row.blocks), (label, at)
    for b in row.blocks:
        assert b.containment == max(s for label, at, s in met if label == b.label and b.first_word <= at <= b.last_word and s <= b.containment)
    assert score == (1.0 if places else max((s for *_, s in met), default=0.0))


def noisy(rng):
    """License sentences with words left out, swapped, broken over lines or put among others."""
    words = []
    for _ in range(rng.randint(0, 4)):
        own = rng.choice(L.TEMPLATES)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            own[rng.randrange(len(own))] = rng.choice(["the", "", "foo", "License"])
        if rng.random() < 0.3:
            rng.shuffle(own)
        words += ["lorem"] * rng.randint(0, 30) + own
    if rng.random() < 0.4:
        words += rng.choice(["CC-BY", "All rights\nreserved", "GENERAL public LICENSE", "all rights not reserved"]).split()
    return rng.choice([" ", "\n", ", "]).join(words)


def test_rows_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, noisy(rng)) for i in range(250)] + [(900, None), (901, ""), (902, "..."), (None, "cc by"), (903, "All rights reserved. all RIGHTS reserved"), (903, "All rights reserved. all RIGHTS reserved")]
    table = docs(spark, rows)
    out = L.scanned(table).collect()
    texts = {i: t for i, t in rows}
    assert len(out) == len(rows) and {b.label for r in out for b in r.blocks} == {label for label, _ in L.TEMPLATES}
    for r in out:
        agrees(r, texts[r.doc_id], r["score_"])


def test_other_thresholds_and_the_order_of_words(spark):
    """A lower threshold finds more; the order of words prunes and never decides."""
    rng = random.Random(3)
    templates = (("one", "a b c d e f g h"), ("two", "c d x y"), ("none", "..."))
    rows = [(i, " ".join(rng.choice("abcdefghxyz") for _ in range(rng.randint(0, 60)))) for i in range(80)]
    seen = []
    for threshold in (0.5, 0.75, 1.0):
        out = L.scanned(docs(spark, rows).select("doc_id", "text"), templates, (("x y", "xy"),), threshold, 1).collect()
        for r in out:
            agrees(r, dict(rows)[r.doc_id], r.score, templates=[t for t in templates if alnum(t[1])], phrases=(("x y", "xy"),), threshold=threshold, slack=1)
        seen.append(sum(len(r.blocks) > 0 for r in out))
    assert seen[0] > seen[1] > seen[2] > 0


def test_words_are_ordered_rarest_first(spark):
    known = L.vocabulary((("t", "the of and zyx qrs"),), ())
    counts = L.frequencies(docs(spark, [(1, "the of and the of the zyx qrs qrs and and of of the the"), (2, None), (3, "theof the")]), known)
    assert dict(zip(known.known, counts.tolist(), strict=True)) == {b"the": 6, b"of": 4, b"and": 3, b"zyx": 1, b"qrs": 2}
    (template,) = L.ordered((("t", "the of and zyx qrs"),), known, counts, 0.8, 2)
    order = sorted(range(5), key=lambda i: template.rank[i])
    assert [known.known[i].decode() for i in order] == ["zyx", "qrs", "and", "of", "the"] and template.need == 4


def test_very_long_text_clashing_columns_and_empty_tables(spark):
    long = "word " * 900_000 + "Released under\nthe MIT License " + "the " * 10_000 + "all rights reserved"
    table = docs(spark, [(1, long), (2, "x")]).selectExpr("doc_id", "text", "1 as places", "2 as Score", "3 as n_words")
    out = L.scanned(table)
    assert out.columns == ["doc_id", "text", "places", "Score", "n_words", "n_words_", "places_", "blocks", "score_"]
    r = out.where("doc_id = 1").first()
    n = len(re.findall(r"\S+", long))
    assert (r.n_words_, r.places_[0].first_word, r.score_) == (n, n - 3, 1.0)
    assert [(b.label, b.first_word, b.last_word >= 900_004, b.containment) for b in r.blocks] == [("mit", 900_000, True, 1.0)]
    assert L.scanned(docs(spark, [])).count() == 0


def test_whole_small_table(spark):
    read = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = L.run(spark, SF).collect()
    assert len(out) == len(read)
    for r in out:
        n, places, met = brute(read[r.doc_id])
        base = sorted({p[0] for p in places})
        starts = [p[1] for p in places]
        assert (r.n_words, r.n_base, r.base_labels, r.first_word, r.last_word) == (n, len(places), ",".join(base), min(starts, default=None), max(starts, default=None))
        assert r.labels == ",".join(sorted({*base, *(m[0] for m in met)})) and r.score == (1.0 if places else max((m[2] for m in met), default=0.0))
