import random
import re
import time
from collections import defaultdict

import numpy as np

from lodeframe.llm import substring_dedup as S
from lodeframe.llm import textnum as X

from .helpers import docs

SF = "/root/testdata/sf0.001"


def split(text, rule=S.SpanRule()):
    """(start, words) of each sentence, by character."""
    out, words = [], [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    for i, (a, _, w) in enumerate(words):
        gap = text[words[i - 1][1] : a] if i else "\n"
        if "\n" in gap or re.search(r"[.!?]", gap) and re.search(r"[ \t\r\x0b\x0c]", gap) or len(out[-1][1]) == rule.longest:
            out.append((a, []))
        out[-1][1].append(w)
    return out


def word_hash(word, memory={}):  # noqa: B006
    """The hash by which passages begin; all else is compared by words."""
    if word not in memory:
        data = np.frombuffer(word.encode(), np.uint8)
        memory[word] = int(X.word_hashes(data, np.array([0]), np.array([len(data)]))[0])
    return memory[word]


def brute(rows, rule=S.SpanRule()):
    """Runs of sentences and, with a window, passages, compared word by word; all that a non-first one covers goes."""
    units = {i: split(t, rule) for i, t in rows}
    seen = defaultdict(list)
    for i in sorted(units):
        of, words = units[i], [w for u in units[i] for w in u[1]]
        heads = [sum(len(u[1]) for u in of[:j]) for j in range(len(of) + 1)]
        for j in range(len(of)):
            for end in range(j + rule.run, len(of) + 1):
                key = tuple(tuple(u[1]) for u in of[j:end])
                if sum(map(len, key)) >= rule.least_words:
                    seen[key].append((i, heads[j], heads[end]))
                    break
        if rule.window:
            begins = set()
            for j in range(len(words) - rule.window + 1):
                hashes = [word_hash(w) for w in words[j : j + rule.window]]
                begins |= {j + k for k, h in enumerate(hashes) if h == min(hashes)}
            long, at = [], 0
            for whole in split(dict(rows)[i], S.SpanRule(longest=10**9)):
                long += [len(whole[1]) > rule.longest] * len(whole[1])
            for j in sorted(begins):
                if j + rule.passage <= len(words) and any(long[j : j + rule.passage]):
                    seen[tuple(words[j : j + rule.passage])].append((i, j, j + rule.passage))
    gone = defaultdict(set)
    for places in seen.values():
        for i, a, b in places[1:]:
            gone[i] |= set(range(a, b))
    out = {}
    for i, t in rows:
        u, lost = units[i], 0
        if gone[i]:
            found = [m.start() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
            kept = t[: found[0]] + "".join(t[a:b] for k, (a, b) in enumerate(zip(found, [*found[1:], len(t)], strict=True)) if k not in gone[i])
            at = 0
            for _, ws in u:
                lost += any(k in gone[i] for k in range(at, at + len(ws)))
                at += len(ws)
            t = kept.rstrip() if len(gone[i]) < len(found) else ""
        out[i] = (len(u), lost, t)
    return out


PASSAGE = "The quick brown fox jumps over it. Then it sleeps for a long while! Nobody knows why that is so? The end of it came soon."


def test_rows_equal_brute_force(spark):
    long_line = " ".join(f"w{i % 37}" for i in range(80))
    rows = [(1, f"Intro one here. {PASSAGE} Tail of one."), (2, f"Other start.\n{PASSAGE}\nOther tail é."), (3, PASSAGE), (4, "Is. Es. It. Is. Es. It."), (5, "Is. Es. It."), (6, None), (7, ""), (8, long_line), (9, f"x {long_line}. y"), (10, long_line), (11, "a b c d e f. " * 8), (13, "TO!! BE!! OR!! NOT!! " * 5), (14, "Yes. " + "TO!! BE!! OR!! NOT!! " * 4 + "No."), (12, "192.168.0.1 is an address, e.g. here and there. Yes.")]
    out = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in S.without_repeats(docs(spark, rows)).collect()}
    assert out == brute(rows)
    assert "quick" not in out[2][2] and out[2][2].startswith("Other start.") and out[3] == (4, 4, "")


def test_whole_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in S.run(spark, SF).collect()} == brute(rows, S.WHOLE)
    plain = S.without_repeats(spark.read.parquet(f"{SF}/documents.parquet"))
    assert {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in plain.collect()} == brute(rows)


def test_null_ids_repeats_columns_and_an_empty_table(spark):
    rows = [(None, PASSAGE), (4, PASSAGE), (4, PASSAGE), (9, PASSAGE)]
    unlike = [(None, f"Some words of {k} here. {PASSAGE}") for k in range(40)] + [(2**63 - 1, PASSAGE), (7, f"Of another text here. {PASSAGE}"), (7, PASSAGE)]
    out = S.without_repeats(docs(spark, unlike)).collect()
    assert all(r.n_removed == 4 for r in out if r.doc_id != 7) and sorted(r.n_removed for r in out if r.doc_id == 7) == [0, 4]
    df = S.without_repeats(docs(spark, rows))
    out = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in df.collect())
    assert out == [(False, 4, 0), (False, 4, 0), (False, 9, 4), (True, 0, 4)]
    clash = docs(spark, rows[1:]).selectExpr("doc_id", "text", "7 as n_sentences", "8 as places", "9 as D", "1 as span", "text as tkey")
    again = S.without_repeats(clash)
    assert again.columns == [*clash.columns, "n_sentences_", "n_removed"] and {(r.n_sentences, r.places, r.D, r.span) for r in again.collect()} == {(7, 8, 9, 1)}
    assert sorted((r.doc_id, r.n_removed) for r in again.collect()) == [(4, 0), (4, 0), (9, 4)]
    assert df.columns == [*docs(spark, []).columns, "n_sentences", "n_removed"] and S.without_repeats(docs(spark, [])).count() == 0


def test_passages_without_full_stops_at_any_offset(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    some = lambda n: " ".join(word() for _ in range(n))
    rows, passages = [], []
    for k in range(36):
        p = some(50 + k % 20)
        passages += [(2 * k + 1, p)]
        rows += [(2 * k, f"{some(12)} {p} {some(9)}"), (2 * k + 1, f"{some(12 + k)} {p} {some(k % 5)}")]
    half = f"{some(20)}. {some(30)}"  # a full stop inside
    rows += [(900, f"{some(4)} {half} {some(9)}"), (901, f"{some(11)} {half} {some(15)}"), (902, some(300))]
    passages += [(901, half)]
    out = {r.doc_id: r for r in S.without_repeats(docs(spark, rows), S.WHOLE).collect()}
    text = dict(rows)
    assert all(out[i].text == text[i] and out[i].n_removed == 0 for i in text if i % 2 == 0)
    for i, p in passages:
        around = text[i].split(p)
        assert out[i].n_removed > 0 and out[i].text.startswith(around[0]) and out[i].text.endswith(around[1].strip())
        assert len(out[i].text.split()) <= len(text[i].split()) - len(p.split()) + 22


def test_very_common_runs_and_a_very_long_text(spark):
    common = [(i, f"Only number {i} has this. {PASSAGE}") for i in range(3000)]  # so common that the sample shows it
    out = S.without_repeats(docs(spark, common), S.WHOLE).collect()
    assert {r.doc_id for r in out if not r.n_removed} == {0} and all(r.text == f"Only number {r.doc_id} has this." for r in out if r.doc_id)
    rng = random.Random(8)
    long = " ".join(f"{rng.randrange(10**9):x}" for _ in range(400_000))
    began = time.perf_counter()
    out = {r.doc_id: r for r in S.without_repeats(docs(spark, [(1, long), (2, "before it " + long)]), S.WHOLE).collect()}
    assert out[1].text == long and out[2].n_removed > 33_000 and len(out[2].text.split()) <= 24 and time.perf_counter() - began < 60
