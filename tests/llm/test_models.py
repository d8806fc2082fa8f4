"""Toxicity, language and token counts: held-out accuracy, brute force and edge cases."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from lodeframe.llm import language_id as L
from lodeframe.llm import textnum as X
from lodeframe.llm import token_counts as C
from lodeframe.llm import toxicity as T

from .helpers import docs, spaced

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    length = np.array([3, 1, 5, 2])
    head = np.concatenate([[0], np.cumsum(length)[:-1]])
    e, moves = rng.normal(0, 2, length.sum()), rng.normal(0, 1, (2, 2))
    p, counts, total = T.marginals(e, head, length, moves)
    want, moved, log_z = np.zeros(len(e)), np.zeros((2, 2)), 0.0
    for h, n in zip(head, length, strict=True):
        z, m, c = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[h + i] * t for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            z += w
            m += w * np.array(tags)
            for a, b in zip(tags, tags[1:], strict=False):
                c[a, b] += w
        want[h : h + n] = m / z
        moved += c / z
        log_z += np.log(z)
    assert np.allclose(p, want) and np.allclose(counts, moved) and total == pytest.approx(log_z)


def test_toxicity_held_out(spark):
    out = T.run(spark, "/root/testdata/sf0.1")
    both = out.where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    hit = (both.predicted == both.toxic).mean()
    assert hit >= 0.97 and both.score.between(0, 1).all()
    caught = both[both.toxic == 1].predicted.mean()
    assert caught >= 0.85
    # Spans are code points of the text.
    text = dict(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False))
    words = {text[r.doc_id][a:b].lower() for r in out.where("size(spans) > 0").collect() for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)}
    assert "idiot" in words and all(" " not in w for w in words)


def toxic_tables(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(i, " ".join(["vile" + rng.choice("xyz") if i % 4 == 0 and k % 7 == 0 else word() for k in range(30)])) for i in range(200)]
    return rows, [(i, int(i % 4 == 0)) for i, _ in rows]


def test_toxicity_edges(spark):
    rows, labels = toxic_tables(spark)
    rows += [(900, None), (901, ""), (902, "..."), (903, "vilew stuff vilez " * 3), (903, "vilew stuff vilez " * 3), (None, "vilex " * 6)]
    lab = spark.createDataFrame([*labels, (5, None), (99999, 1), (None, 1)], "doc_id long, toxic int")
    out = [(r.doc_id, r.predicted, r.score) for r in T.scored(docs(spark, rows), lab).collect()]
    assert len(out) == len(rows)
    by = {i: (p, s) for i, p, s in out}
    assert by[900] == by[901] == by[902] == (0, 0.0) and by[903][0] == 1 and by[None][0] == 1
    kept = T.without_toxic(docs(spark, rows), lab)
    assert kept.columns == docs(spark, []).columns and {900, 901, 902} <= {r.doc_id for r in kept.collect()}
    assert kept.where("text like '%vile%'").count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in T.scored(docs(spark, rows), none).collect()} == {0}
    assert T.scored(docs(spark, []), lab).count() == 0


def test_long_texts_leave_the_sample_whole(spark):
    rows, labels = toxic_tables(spark)
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) + "." * (k % 9 == 0) for k in range(30_000))
    rows += [(-3, "q" * 90_000), (-2, "vilex " + long), (-1, long[::-1])]
    lab = spark.createDataFrame([*labels, (-3, 0), (-2, 1), (-1, 0)], "doc_id long, toxic int")
    rule = T.ToxicityRule(sample_bytes=60_000)
    drawn = T.training_rows(docs(spark, rows), lab, T.ToxicityRule(sample_bytes=60_000, held_out=9)).collect()
    text = dict(rows)
    assert {r.doc_id for r in drawn} == set(text) and sum(len(r.text.encode()) for r in drawn) <= rule.sample_bytes
    assert all(r.text == text[r.doc_id] for r in drawn if r.doc_id >= 0) and all(len(r.text) > 5_000 for r in drawn if r.doc_id < 0)
    fresh = [(1000 + i, f"abcd {w} efgh {w} " * 3) for i, w in enumerate(("vilex", "vilez", "hgfe"))]
    assert {r.doc_id: r.predicted for r in T.scored(docs(spark, fresh), lab, docs(spark, rows), rule).collect()} == {1000: 1, 1001: 1, 1002: 0}


def test_a_sample_does_not_depend_on_ids_or_repeats(spark):
    """A very long labelled text of the smallest id leaves all others in the sample; an id of two texts teaches by both."""
    rows, labels = toxic_tables(spark)
    rows = [(-9, "harmless words and more of them. " * 280_000), *rows, (4, rows[4][1]), (4, "another vilex vilez text " * 3)]
    lab = spark.createDataFrame([*labels, (-9, 0)], "doc_id long, toxic int")
    rule = T.ToxicityRule(held_out=9)
    drawn = T.training_rows(docs(spark, rows), lab, rule).collect()
    assert len(drawn) == 202 and sum(r.doc_id == 4 for r in drawn) == 2 and sum(len(r.text) for r in drawn) <= rule.sample_bytes
    fresh = docs(spark, [(1000, "abcd vilex efgh vilez " * 3), (1001, "abcd efgh " * 6)])
    assert {r.doc_id: r.predicted for r in T.scored(fresh, lab, docs(spark, rows), rule).collect()} == {1000: 1, 1001: 0}


def test_scores_equal_slow_enumeration(spark):
    """The query's scores from the fitted weights by plain Python: features, forward-backward in logarithms, pooling."""
    rows, labels = toxic_tables(spark)
    lab, rule = spark.createDataFrame(labels, "doc_id long, toxic int"), T.ToxicityRule()
    table = docs(spark, [*rows[:30], (500, "vilex. Is it? vilez\nabcd"), (501, "x " * 130)])
    field = T.fitted(docs(spark, rows), lab, rule)

    def bucket(word, more=0):
        data = np.frombuffer(word.encode(), np.uint8)
        return (int(X.word_hashes(data, np.array([0]), np.array([len(data)]))[0]) + more) % 2**64 % rule.buckets

    def slow(text):
        marginal = []
        for sentence in re.split(r"(?<=[.!?])\s|\n", text):
            words = re.findall("[0-9a-z]+", sentence.lower())
            for chain in (words[i : i + 64] for i in range(0, len(words), 64)):
                e = [field.bias + field.weights[bucket(w)] + sum(field.weights[bucket(w[:k], k)] for k in rule.prefixes) for w in chain]
                forward = [[0.0, e[0]]]
                for x in e[1:]:
                    forward.append([np.logaddexp(forward[-1][0] + field.moves[0, t], forward[-1][1] + field.moves[1, t]) + x * t for t in (0, 1)])
                back = [0.0, 0.0]
                z, own = np.logaddexp(*forward[-1]), []
                for i in range(len(e) - 1, -1, -1):
                    own.append(np.exp(forward[i][1] + back[1] - z))
                    back = [np.logaddexp(field.moves[t, 0] + back[0], field.moves[t, 1] + e[i] + back[1]) for t in (0, 1)]
                marginal += own
        loud = [p for p in marginal if p >= rule.floor]
        x = np.array([1, min(sum(loud), rule.ceiling), max(loud, default=0)]) @ field.scale
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    out = {r.doc_id: r.score for r in T.scored(table, lab, docs(spark, rows)).collect()}
    text = dict([*rows[:30], (500, "vilex. Is it? vilez\nabcd"), (501, "x " * 130)])
    assert all(out[i] == pytest.approx(slow(text[i]), abs=1e-6) for i in out) and len(out) == 32


def test_language_held_out(spark):
    both = L.run(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (both.lang == both.lang_pred).mean() >= 0.97 and both.score.between(0, 1).all()


def test_language_edges(spark):
    train = [(i, "the house and the garden are here " * 3 if i % 2 else "der hund und die katze sind da " * 3) for i in range(30)]
    df = docs(spark, train).selectExpr("doc_id", "text", "if(doc_id % 2 = 1, 'en', 'de') as lang")
    rows = docs(spark, [(1, None), (2, ""), (3, "123 ... 4"), (4, "中文"), (5, "the garden"), (5, "the garden"), (None, "die katze"), (6, "the house and the garden are here der hund und die katze sind da"), (7, "x" * 300_000)])
    out = L.identified(rows, df).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 9 and [by[i].lang_pred for i in (1, 2, 3, 5, None)] == ["und", "und", "und", "en", "de"] and by[1].score == 0
    assert by[4].lang_pred in ("en", "de") and set(by[6].languages) == {"en", "de"} and by[7].lang_pred != "und"
    assert {r.lang_pred for r in L.identified(rows, df.limit(0)).collect()} == {"und"}
    assert L.identified(rows.limit(0), df).count() == 0


def test_mixture_finds_the_best_proportions():
    """Two languages: no proportion of a fine grid is likelier, and the set is the one of the best penalised likelihood."""
    rng = np.random.default_rng(3)
    for share in (0.0, 0.1, 0.5, 0.9):
        n = 60
        words = rng.normal(0, 1, (n, 2)) + np.where(rng.random(n) < share, 4, -4)[:, None] * np.array([0.5, -0.5])
        times = rng.integers(1, 4, n)
        order, held, chosen, whole = L.mixture([(np.zeros(n, np.int64), words, times)], np.array([times.sum()]), 2, 200)
        fit = lambda p: float((times * np.log(p * np.exp(words[:, 0]) + (1 - p) * np.exp(words[:, 1]))).sum())
        own = held[0][order[0].tolist().index(0)]
        assert fit(own) >= max(fit(p) for p in np.linspace(0.001, 0.999, 999)) - 1e-3
        single = fit(1.0) if order[0, 0] == 0 else fit(0.0)
        assert chosen[0] == 1 + (fit(own) - 0.5 * np.log(times.sum() + 1) > single + 1e-9)
        assert np.allclose(whole[0], (words * times[:, None]).sum(0))


def test_language_blocks_change_nothing(monkeypatch):
    rng = random.Random(5)
    table = np.array([[[rng.randrange(50) for _ in range(3)] for _ in range(1 << 8)] for _ in range(2)], float)
    rule = L.LanguageRule(bits=8)

    class Model:
        value = (["a", "b", "c"], L._log_table(table, rule))

    texts = ["".join(rng.choice("abcdef  é1") for _ in range(rng.randint(0, 300))) for _ in range(40)] + ["word " * 3000, None, "x" * 700]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    want = next(L._predict(Model, rule)(iter([batch])))
    monkeypatch.setattr(L, "CELLS", 60)
    got = next(L._predict(Model, rule)(iter([batch])))
    assert got.column(1) == want.column(1) and np.allclose(got.column(2).to_numpy(), want.column(2).to_numpy())


def test_long_texts_are_read_in_stretches(monkeypatch):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 30))) for _ in range(900)) + " " + "q" * 4000 + " end"
    data, offsets = X.column_bytes(pa.array(["", text]))
    for longest in (None, 200):
        parts = list(X.stretches(data, offsets, X.SPACED[0], 500, longest))
        assert b"".join(d.tobytes() for d, _, _ in parts) == data.tobytes() and {first for _, _, first in parts} == {1} and len(parts) > 20
        assert longest or sum(len(X.words(d, o, X.SPACED)[0]) for d, o, _ in parts) == len(text.split())
    whole = C.Counter(C.load_pieces())(data, offsets)
    monkeypatch.setattr(X, "BLOCK", 300)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["", text])], names=["doc_id", "text"])

    class Pieces:
        value = C.load_pieces()

    out = pa.Table.from_batches(C._count(Pieces, 1)(iter([batch])))
    assert out.column("n_tokens").to_pylist() == whole[1].tolist() and out.column("n_pretokens").to_pylist() == whole[0].tolist()


def test_too_many_languages_raise(spark):
    df = docs(spark, [(i, "some text") for i in range(30)]).selectExpr("doc_id", "text", "concat('l', doc_id) as lang")
    with pytest.raises(ValueError, match="languages"):
        L.identified(df, rule=L.LanguageRule(languages=5))


@pytest.mark.parametrize("wide", [1, 3, 64, 10**6])
def test_trie_equals_plain_dynamic_programming(monkeypatch, wide):
    monkeypatch.setattr(C, "WIDE", wide)
    rng = random.Random(8)
    pieces = C.ranked_pieces([p.encode() for p in ["a", "b", "ab", "aba", "bb", "é", "éa", "abab", "▁a", "▁", "ba"]])
    tokens = sorted({C.MARK + "".join(rng.choice(["a", "b", "é", "z"]) for _ in range(rng.randint(1, 12))).encode() for _ in range(400)})
    assert C.trie_counts(tokens, pieces).tolist() == [C.count_one(t, pieces) for t in tokens]


def test_unspaced_texts_go_through_the_trie():
    pieces = C.load_pieces()
    rng = random.Random(9)
    line = lambda n: C.MARK + "".join(rng.choice("的一是不了人我在有他这为之大来以个中上们") for _ in range(n)).encode()
    tokens = list({line(rng.randint(5, 200)) for _ in range(300)})
    tokens += [tokens[0] + b"x", tokens[0] * 3]
    assert C.trie_counts(tokens, pieces).tolist() == [C.count_one(t, pieces) for t in tokens]
    began = time.perf_counter()
    assert C.trie_counts([line(340_000)], pieces)[0] > 100_000 and time.perf_counter() - began < 60


def test_token_counts_of_a_whole_table(spark):
    """Every document of the smallest tables by plain dynamic programming of each word."""
    small, pieces, known = "/root/testdata/sf0.001", C.load_pieces(), {}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    count = lambda w: known.setdefault(w, C.count_one(C.MARK + w.encode(), pieces)) if w not in known else known[w]
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert {tuple(r) for r in C.run(spark, small).collect()} == {(r.doc_id, len(split(r.text)), sum(map(count, split(r.text)))) for r in rows}


def brute_count(token, pieces):
    """Best segmentation by enumeration: highest score, then fewest tokens."""
    best = None
    for cuts in range(1 << (len(token) - 1)):
        at, parts = 0, []
        for i in range(1, len(token) + 1):
            if i == len(token) or cuts >> (i - 1) & 1:
                parts.append(token[at:i])
                at = i
        if all(p in pieces.scores or len(p) == 1 for p in parts):
            key = (round(-sum(max(pieces.scores.get(p, -1e9), pieces.byte_score if len(p) == 1 else -1e9) for p in parts), 6), len(parts))
            best = key if best is None or key < best else best
    return best[1]


def test_counts_equal_enumeration():
    pieces = C.ranked_pieces([b"a", b"b", b"ab", b"aba", b"bb", b"ba"])
    for n in range(1, 8):
        for letters in itertools.product(b"abz", repeat=n):
            if letters[0] != ord("z"):
                assert C.count_one(bytes(letters), pieces) == brute_count(bytes(letters), pieces)


def test_token_counts_of_a_table(spark):
    pieces = C.load_pieces()
    long = "y" * 5000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "hello  world\té"), (4, "hello  world\té"), (None, long), (5, "hello " * 20_000)]
    out = C.token_counts(docs(spark, rows)).collect()
    want = [(i, len(spaced(t)), sum(C.count_one(C.MARK + w.encode(), pieces) for w in (t or "").encode().decode().split())) for i, t in rows]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str) and C.token_counts(docs(spark, [])).count() == 0


def test_word_hashes_depend_on_bytes_alone():
    data, offsets = X.column_bytes(pa.array(["aa bb", "bb", "x aa" + " " * 10 + "bb"]))
    starts, ends, at = X.words(data, offsets, X.SPACED)
    h = X.word_hashes(data, starts, ends)
    assert at.tolist() == [0, 2, 3, 6] and h[0] == h[4] and h[1] == h[2] == h[5] and h[0] != h[1]
    big = np.frombuffer(b"q" * (X.BLOCK + 5), np.uint8)
    one = X.word_hashes(big, np.array([0]), np.array([len(big)]))
    two = X.word_hashes(np.concatenate([np.zeros(9, np.uint8), big]), np.array([9]), np.array([len(big) + 9]))
    assert one[0] == two[0]
