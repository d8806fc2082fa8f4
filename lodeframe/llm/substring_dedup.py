"""Substring deduplication by sliding sentence spans.

A text is cut into sentences; from each one the shortest run of ``run`` consecutive sentences
or more that holds ``least_words`` words is hashed, hashes of 128 bits meet over all documents, and the
sentences that any non-first occurrence of a repeated run covers are removed.  The first occurrence is the one
of the smallest doc_id, then the smallest place in its text.

Runs are shuffled once, by hash, and ranked there.  The few hashes that a sample of rows shows to be
very common are kept out of that: their first occurrences are a broadcast of bounded size, so a run
that a third of all documents hold goes through no single task.

A sentence ends at ``.``, ``!`` or ``?`` before white space, or at a line's end; one with more
than ``longest`` words counts as several of that many words, so that passages without full
stops have runs too.  Sentences are compared by their words alone (letters and digits, lower
case): white space and punctuation do not tell copies apart.

Pieces of ``longest`` words line up only where a passage begins at the same place of its sentence
in each text.  With a ``window`` (``WHOLE``, as the query and the pipeline use it), passages are
compared too: ``(run - 1) * longest + 1`` words, the fewest that a sentence of ``run`` pieces holds,
of which one at least is of a sentence of more than ``longest`` words.  They begin at words whose
hash is the least of some ``window`` consecutive words.  The least of a window that lies inside a
repeated passage is the same in each text, so every repeat of ``window + (run - 1) * longest`` words
(36) is found wherever it begins, and at most ``window - 1`` of its words stay at either end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum as X
from .scratch import common_keys, dropped, free, written


@dataclass(frozen=True)
class SpanRule:
    run: int = 3
    longest: int = 12
    least_words: int = 10
    window: int = 0

    @property
    def passage(self) -> int:
        return (self.run - 1) * self.longest + 1


#: Sentences, and passages inside long ones wherever they begin.
WHOLE = SpanRule(window=12)
#: Marks a place that counts words, not sentences.
_PASSAGE = 1 << 30


def _flags(values: bytes) -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[list(values)] = 1
    return table


_STOP, _SPACE, _LINE = _flags(b".!?"), _flags(b" \t\n\r\x0b\x0c"), _flags(b"\n")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: first byte and hash of each word, whether it begins a sentence; word offsets of the texts."""
    starts, ends, at = X.words(data, offsets, X.ALNUM)
    m = len(starts)
    hashes = X.word_hashes(data, starts, ends, X.ALNUM[1])
    first = np.ones(m, bool)
    if m:
        gap = []
        for t in (_STOP, _SPACE, _LINE):  # counts between neighbouring words
            sums = np.zeros(len(data) + 1, np.int32)
            np.cumsum(t[data], out=sums[1:])
            gap.append(sums[starts[1:]] - sums[ends[:-1]])
        first[1:] = ((gap[0] > 0) & (gap[1] > 0)) | (gap[2] > 0)
        first[at[:-1][at[:-1] < at[1:]]] = True
    return starts, hashes, first, at


def _heads(first: np.ndarray, rule: SpanRule) -> np.ndarray:
    """The first word of each sentence, or of each piece of a long one."""
    index = np.arange(len(first))
    place = index - np.maximum.accumulate(np.where(first, index, 0))
    return np.flatnonzero(place % rule.longest == 0)


def _hashed(hashes: np.ndarray, first: np.ndarray, at: np.ndarray, rule: SpanRule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and word count of each sentence; sentence offsets of the texts."""
    head = _heads(first, rule)
    words = np.diff(np.append(head, len(first)))
    mixed = np.zeros(len(head), dtype=X.U64)
    for i in range(rule.longest):  # Horner over the words of every sentence at once
        has = words > i
        mixed[has] = mixed[has] * X.U64(0xFF51AFD7ED558CCD) + hashes[head[has] + i]
    return head, X.mix(mixed + words.astype(X.U64)), words, np.searchsorted(head, at)


def sentences(data: np.ndarray, offsets: np.ndarray, rule: SpanRule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: first byte, hash and word count of each sentence; sentence offsets of the texts."""
    starts, hashes, first, at = _words(data, offsets)
    head, mixed, words, of = _hashed(hashes, first, at, rule)
    return starts[head], mixed, words, of


def passages(hashes: np.ndarray, first: np.ndarray, at: np.ndarray, rule: SpanRule) -> np.ndarray:
    """The first word of every passage that touches a long sentence."""
    m, w = len(hashes), rule.window
    if m < max(w, rule.passage):
        return np.zeros(0, np.int64)
    least = hashes[: m - w + 1].copy()  # of the window that begins at each word
    for i in range(1, w):
        np.minimum(least, hashes[i : m - w + 1 + i], out=least)
    index = np.arange(m)
    stop = np.repeat(at[1:], np.diff(at))
    least[index[: m - w + 1] + w > stop[: m - w + 1]] = 0  # windows do not cross texts
    chosen = np.zeros(m, bool)
    for i in range(w):
        chosen[i : m - w + 1 + i] |= hashes[i : m - w + 1 + i] == least
    begin = np.flatnonzero(chosen & (index + rule.passage <= stop))
    size = np.diff(np.append(np.flatnonzero(first), m))
    long = np.concatenate([[0], np.cumsum(np.repeat(size > rule.longest, size))])
    return begin[long[begin + rule.passage] > long[begin]]


def runs(words: np.ndarray, rule: SpanRule) -> np.ndarray:
    """The sentence behind the run that starts at each sentence; it may lie beyond the text, or be one past all + 1 if there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    first = np.arange(len(words))
    return np.maximum(first + rule.run, np.searchsorted(total, total[:-1] + rule.least_words))


def _spans(rule: SpanRule):
    """(span, check, doc_id, tkey, place) of every run; span and check: 128 bits of its words; place: the run's sentence number, or _PASSAGE and a passage's word number."""

    def both(of: X.RangeHashes, more: X.RangeHashes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = (end - begin).astype(X.U64)
        return X.mix(of(begin, end) + n), X.mix(more(begin, end) + n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            data, offsets = X.column_bytes(batch.column(2))
            _, each, head, of = _words(data, offsets)
            if not len(each):
                continue
            _, hashes, words, at = _hashed(each, head, of, rule)
            first, last = np.arange(len(hashes)), runs(words, rule)
            doc = np.searchsorted(at, first, side="right") - 1
            keep = first[last <= at[doc + 1]]
            doc, last = doc[keep], last[keep]
            span, check = both(X.RangeHashes(hashes), X.RangeHashes(X.mix(~hashes)), keep, last)
            place = keep - at[doc]
            if rule.window:
                begin = passages(each, head, of, rule)
                inside = np.searchsorted(of, begin, side="right") - 1
                more = both(X.RangeHashes(each), X.RangeHashes(X.mix(~each)), begin, begin + rule.passage)
                span, check = np.concatenate([span, X.mix(~more[0])]), np.concatenate([check, X.mix(~more[1])])
                place = np.concatenate([place, (begin - of[inside]) | _PASSAGE])
                doc = np.concatenate([doc, inside])
            which = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(X.signed(span)), pa.array(X.signed(check)), batch.column(0).take(which), batch.column(1).take(which), pa.array(place.astype(np.int32))], names=["span", "check", "doc_id", "tkey", "place"])

    return run


def _covered(places: np.ndarray, bound: np.ndarray, last: np.ndarray, base: int, n: int, rule: SpanRule) -> np.ndarray:
    """Which of n words the runs at ``places`` cover; bound: first word of each sentence from this text on, base: the text's first word."""
    whole = places[places & _PASSAGE == 0]
    words = places[places & _PASSAGE != 0] ^ _PASSAGE
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.concatenate([bound[whole] - base, words]), 1)
    np.add.at(steps, np.concatenate([bound[last[whole]] - base, words + rule.passage]), -1)
    return np.cumsum(steps[:-1]) > 0


def _cut(rule: SpanRule, columns: list[str], added: list[str]):
    """Drop the words that the runs in the last column cover; adds two columns, of sentences and of those that lost words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_text = columns.index("text")
        for batch in X.slices(batches):
            data, offsets = X.column_bytes(batch.column(at_text))
            starts, _, first, of = _words(data, offsets)
            head = _heads(first, rule)
            at = np.searchsorted(head, of)
            bound = np.append(head, len(first))
            last = runs(np.diff(bound), rule)
            places = batch.column(batch.num_columns - 1)
            texts, removed = [], []
            for i, hit in enumerate(places.is_valid().to_pylist()):
                if not hit:
                    texts.append(batch.column(at_text)[i].as_py())
                    removed.append(0)
                    continue
                base, n = of[i], of[i + 1] - of[i]
                own = places[i].values.to_numpy().astype(np.int64)
                gone = _covered(own, bound[at[i] :], last[at[i] :] - at[i], base, n, rule)
                begin = np.append(starts[base : of[i + 1]], offsets[i + 1])
                turns = np.concatenate([[0], np.flatnonzero(gone[1:] != gone[:-1]) + 1, [n]])
                kept = [data[offsets[i] : begin[0]], *(data[begin[a] : begin[b]] for a, b in zip(turns[:-1], turns[1:], strict=True) if not gone[a])]
                texts.append(b"".join(x.tobytes() for x in kept).decode().rstrip() if not gone.all() else "")
                removed.append(int(np.logical_or.reduceat(gone, head[at[i] : at[i + 1]] - base).sum()))
            out = [pa.array(texts, pa.string()) if j == at_text else batch.column(j) for j in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64())], names=[*columns, *added])

    return run


def _later(spans: DataFrame) -> DataFrame:
    """(doc_id, tkey, place) of every non-first occurrence of a run."""
    common = common_keys(spans, "span", "doc_id", "tkey", "place")
    first = spans.join(F.broadcast(common), "span", "left_semi").groupBy("span", "check").agg(F.min(F.struct("doc_id", "tkey", "place")).alias("first"))
    first = written(first, "first")
    ranked = spans.join(F.broadcast(common), "span", "left_anti").withColumn("r", F.rank().over(Window.partitionBy("span", "check").orderBy("doc_id", "tkey", "place")))
    hot = spans.join(F.broadcast(first), ["span", "check"]).where(F.struct("doc_id", "tkey", "place") != F.col("first"))
    return ranked.where("r > 1").select("doc_id", "tkey", "place").unionByName(hot.select("doc_id", "tkey", "place"))


def without_repeats(docs: DataFrame, rule: SpanRule = SpanRule()) -> DataFrame:
    """docs with repeated sentences cut from text, plus n_sentences (before) and n_removed (those that lost words).

    A text without a removed word stays as it is, byte for byte; one that loses all its
    sentences becomes empty; a null text stays null.  Texts of fewer sentences than a run are
    never touched; very long ones are read whole.  Rows with a null doc_id come last in the order of
    first occurrences, by hashes of their texts.  Rows that repeat both doc_id and text count as one
    document, and each keeps its row.  An empty table gives no rows; other columns are kept as they
    are.  Where docs has columns of the two added names, the added ones get underscores behind.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("text", F.col("text").cast("string"))
    columns = docs.columns
    added = free(columns, "n_sentences", "n_removed")
    d, t, places = free(columns, "d", "t", "places")
    # A null id comes behind all others, and never meets the row whose id is the largest number.
    order, key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.col("doc_id").isNull(), "text")
    spans = written(docs.select(order.alias("doc_id"), key.alias("tkey"), "text").mapInArrow(_spans(rule), "span long, check long, doc_id long, tkey long, place int"), "spans")
    later = _later(spans).groupBy(F.col("doc_id").alias(d), F.col("tkey").alias(t)).agg(F.collect_set("place").alias(places))
    later = written(later, "places")
    dropped(spark, spans)
    joined = docs.withColumn(d, order).withColumn(t, key).join(later, [d, t], "left").select(*columns, places)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + "".join(f", `{a}` long" for a in added)
    return joined.mapInArrow(_cut(rule, columns, added), kind)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), WHOLE).select("doc_id", "n_sentences", "n_removed", "text")
