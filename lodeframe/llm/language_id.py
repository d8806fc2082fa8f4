"""Language identification as inference of a mixture of languages in every document.

Each language is a model of letter trigrams (bytes, within words), counted over all labelled
documents.  A document is a mixture: each word comes from one language, with the document's
language proportions as prior.  Expectation-maximisation estimates the proportions, then the
set of its largest languages with the best penalised likelihood (half the logarithm of the
number of words for each further language) is selected.  The prediction is the language with
the largest proportion in the selected set.

Texts are read in stretches of a fixed number of bytes and scored in blocks of a fixed number of
(word, language) cells, which every pass of the maximisation takes anew where they are too many to
be kept: neither a very long text nor many languages make a worker hold more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as X


@dataclass(frozen=True)
class LanguageRule:
    """languages: distinct labels that a model is made of; a table with more raises an error, as its lang column is none."""

    folds: int = 3
    held_out: int = 1
    bits: int = 15
    rounds: int = 8
    smoothing: float = 0.3
    languages: int = 400


#: Bytes of a text that are read at once; a text of more is cut there, between words or, in a word of 64 KB or more, inside.
STRETCH = 1 << 20
#: (word or byte, language) cells that are scored at once.
CELLS = 1 << 21


def _grams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """At every byte: the bucket of the trigram and of the bigram that end there; first and past-the-end byte of words; word offsets; the bytes.

    The gap behind a word counts as its last letter; texts are set apart by a gap.
    """
    n = len(offsets) - 1
    low = np.zeros(len(data) + n + 2, np.uint8)
    inside = X.ALNUM[0][data] & ~((data >= 0x30) & (data <= 0x39))
    place = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets)) + 2
    low[place] = np.where(inside, X.ALNUM[1][data], 0)
    starts, ends, at = X.words(low, np.concatenate([[0], offsets[1:] + np.arange(1, n + 1) + 1]).clip(max=len(low)), _LETTERS)
    one = low.astype(np.uint32)
    two = np.zeros_like(one)
    two[1:] = one[:-1]
    three = np.zeros_like(one)
    three[2:] = np.where(two[2:] == 0, 0, one[:-2])
    pair = three * np.uint32(257) + two
    multiplier = np.uint32(2654435761)
    shift = np.uint32(32 - bits)
    tri = ((pair * np.uint32(256) + one) * multiplier) >> shift
    return tri, (pair * multiplier) >> shift, starts, ends, at, low


_LETTERS = X.byte_table([0])
_LETTER = X.ALNUM[0] & ~np.isin(np.arange(256), np.arange(0x30, 0x3A))


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    return X.stretches(data, offsets, _LETTER, STRETCH, longest=1 << 16)


def _counts(rule: LanguageRule):
    """(lang, kind, bucket, count) of a stretch of labelled texts; kind 0: trigrams, 1: their contexts."""
    size = 1 << rule.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, have in total.items():
                kind, bucket = np.nonzero(have)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kind), pa.string()), pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(have[kind, bucket])], names=["lang", "kind", "bucket", "count"])
            total.clear()

        for batch in X.slices(batches):
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                part = batch.filter(pa.array([x == lang for x in langs]))
                if lang not in total and len(total) == 64:  # a worker counts few languages at once
                    yield from rows()
                have = total.setdefault(lang, np.zeros((2, size), np.int64))
                for data, offsets, _ in _stretches(*X.column_bytes(part.column(1))):
                    tri, bi, starts, ends, _, _ = _grams(data, offsets, rule.bits)
                    inside = np.zeros(len(tri) + 1, np.int32)
                    np.add.at(inside, starts, 1)
                    np.add.at(inside, ends + 1, -1)
                    inside = np.cumsum(inside)[:-1] > 0
                    have[0] += np.bincount(tri[inside], minlength=size)
                    have[1] += np.bincount(bi[inside], minlength=size)
        yield from rows()

    return run


def fitted(docs: DataFrame, rule: LanguageRule = LanguageRule()) -> tuple[list[str], np.ndarray]:
    """(languages, counts of trigram and context buckets by language) from all labelled documents outside the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(rule.folds))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold != rule.held_out)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    several = known.select("lang").distinct().limit(rule.languages + 1).count()
    if several > rule.languages:
        raise ValueError(f"more than {rule.languages} languages: clean the lang column or raise LanguageRule.languages")
    rows = known.mapInArrow(_counts(rule), "lang string, kind int, bucket int, count long").groupBy("lang", "kind", "bucket").agg(F.sum("count").alias("n")).toArrow()  # buckets x languages rows at most
    names, langs = np.unique(np.array(rows.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True) if rows.num_rows else (np.array([]), np.array([], int))
    table = np.zeros((2, 1 << rule.bits, len(names)))
    if len(names):
        table[rows.column("kind").to_numpy(), rows.column("bucket").to_numpy(), langs] = rows.column("n").to_numpy()
    return [str(x) for x in names], table


def _log_table(table: np.ndarray, rule: LanguageRule) -> np.ndarray:
    """Trigram scores by bucket and language, as float32; contexts' scores are subtracted at the bucket of the context."""
    kinds = max(1, int((table[0].sum(1) > 0).sum()))
    return np.stack([np.log(table[0] + rule.smoothing * 0.1), np.log(table[1] + rule.smoothing * 0.1 * kinds / 16)]).astype(np.float32)


class Words:
    """The distinct words of each text (of a long one, of each stretch), by blocks: their text, log-likelihood by language, and number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, scores: np.ndarray, rule: LanguageRule) -> None:
        self.data, self.offsets, self.scores, self.rule = data, offsets, scores, rule
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = []
        self.counts = np.zeros(len(offsets) - 1, np.int64)
        cells = 0
        for doc, words, times in self._scored():
            self.counts += np.bincount(doc, weights=times, minlength=len(self.counts)).astype(np.int64)
            cells += words.size
            if self.kept is not None:
                self.kept.append((doc, words, times))
                if cells > 4 * CELLS:
                    self.kept = None

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return iter(self.kept) if self.kept is not None else self._scored()

    def _scored(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n_langs = self.scores.shape[2]
        for data, offsets, owner in _stretches(self.data, self.offsets):
            tri, bi, starts, ends, at, low = _grams(data, offsets, self.rule.bits)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at)) + owner
            starts, ends, doc, times = _distinct(low, starts, ends, doc)
            most = max(1, CELLS // n_langs)  # bytes in a block, or one longer word
            i = 0
            while i < len(starts):
                to = max(i + 1, int(np.searchsorted(ends, starts[i] + most)))
                a, b = starts[i], ends[to - 1] + 1
                each = np.zeros((to - i, n_langs))
                for at_byte in range(a, b, most):  # a word that is a block by itself is summed in parts
                    end = min(b, at_byte + most)
                    part = (self.scores[0][tri[at_byte:end]] - self.scores[1][bi[at_byte:end]]).astype(np.float64)
                    sums = np.concatenate([np.zeros((1, n_langs)), np.cumsum(part, axis=0)])
                    first, last = np.clip(starts[i:to], at_byte, end) - at_byte, np.clip(ends[i:to] + 1, at_byte, end) - at_byte
                    each += sums[last] - sums[first]
                yield doc[i:to], each, times[i:to]
                i = to


def _distinct(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first of each text's equal words, in order: first and end byte, text, and how many are equal to it."""
    hashes = X.mix(X.word_hashes(low, starts, ends) + X.mix(doc.astype(X.U64)))
    _, first, times = np.unique(hashes, return_index=True, return_counts=True)
    order = np.argsort(first)
    first = first[order]
    return starts[first], ends[first], doc[first], times[order]


def _by_doc(doc: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """Add the rows of each text to its row of out; doc is sorted."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    out[doc[first]] += np.add.reduceat(values, first, axis=0)


def mixture(words, counts: np.ndarray, n_langs: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language numbers by falling proportion, proportions in that order, size of the selected set, log-likelihood by language) of each text.

    words: iterable, pass after pass, of blocks (text, log-likelihood by language, number) of distinct words, texts in order.
    """
    n = len(counts)
    total = np.maximum(counts, 1)[:, None]

    def likely(block: np.ndarray) -> np.ndarray:
        return np.exp(np.maximum(block - block.max(1, keepdims=True), -60))

    share = np.full((n, n_langs), 1 / n_langs)
    whole = np.zeros((n, n_langs))
    for turn in range(rounds):
        new = np.zeros((n, n_langs))
        for doc, block, times in words:
            r = likely(block) * share[doc]
            _by_doc(doc, r * (times / r.sum(1))[:, None], new)
            if not turn:
                _by_doc(doc, block * times[:, None], whole)
        share = new / total
    order = np.argsort(-share, axis=1, kind="stable")
    sorted_share = np.take_along_axis(share, order, 1)
    fit = np.zeros((n, n_langs))  # log-likelihood with the m largest languages, their proportions scaled to 1
    for doc, block, times in words:
        gain = np.cumsum(np.take_along_axis(likely(block), order[doc], 1) * sorted_share[doc], axis=1)
        _by_doc(doc, np.log(np.maximum(gain, 1e-300)) * times[:, None], fit)
    fit -= counts[:, None] * np.log(np.maximum(np.cumsum(sorted_share, axis=1), 1e-300))
    fit -= np.arange(n_langs) * 0.5 * np.log(counts + 1)[:, None]
    best, chosen = fit[:, 0].copy(), np.ones(n, np.int64)
    for m in range(1, n_langs):
        better = fit[:, m] > best + 1e-9
        best[better], chosen[better] = fit[better, m], m + 1
    return order, sorted_share, chosen, whole


def _predict(model, rule: LanguageRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scores = model.value
        for batch in X.slices(batches):
            n = batch.num_rows
            lang: list[str] = ["und"] * n
            score, mixed = np.zeros(n), [{} for _ in range(n)]
            data, offsets = X.column_bytes(batch.column(1))
            if len(names) and len(data):
                words = Words(data, offsets, scores, rule)
                order, share, chosen, whole = mixture(words, words.counts, len(names), rule.rounds)
                for i in np.flatnonzero((words.counts > 0) & _has_letter(data, offsets, batch.column(1))).tolist():
                    m = int(chosen[i])
                    held = share[i, :m] / share[i, :m].sum()
                    mixed[i] = {names[int(order[i, j])]: float(held[j]) for j in range(m)}
                    lang[i] = names[int(order[i, 0])]
                    own = np.exp(np.maximum(whole[i] - whole[i].max(), -60))
                    score[i] = held[0] if m > 1 else own[order[i, 0]] / own.sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(mixed, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "languages"])

    return run


def _has_letter(data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    folded = data | 0x20
    out, some = np.zeros(len(offsets) - 1, bool), np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.logical_or.reduceat((folded >= 0x61) & (folded <= 0x7A) & (data < 0x80), offsets[some])
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return out


def identified(docs: DataFrame, train_docs: DataFrame | None = None, rule: LanguageRule = LanguageRule()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) for every row of docs.

    lang_pred is ``und``, with score 0, for a null text or one without a letter, and everywhere if
    no labelled document was given.  score is the predicted language's proportion in the selected
    set or, for a set of one, its probability among all single languages.  Very long texts are read
    whole.  Repeated rows keep a row each; a null doc_id is not held out and teaches nothing; equal
    proportions go by the language's name.  An empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    names, table = fitted(train_docs if train_docs is not None else docs, rule)
    model = docs.sparkSession.sparkContext.broadcast((names, _log_table(table, rule)))
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(_predict(model, rule), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, languages map<string,double>")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(rule.folds))
    return out.select("doc_id", F.coalesce(fold == rule.held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
