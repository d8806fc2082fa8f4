"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over documents.

A window is ``size`` consecutive words of an item; an item with fewer words (but not none) is
one window of all its words.  Each document's windows are looked up by hash in sorted arrays,
hits are verified word by word, and the words inside any occurrence are marked.

The hash set is broadcast in parts of about ``bound`` windows, whose number is counted first.  A
benchmark of one part needs a scan of the documents and no shuffle.  One of more parts needs a scan
for each part; its hits are written before the next part is sent, so that driver and executors hold
one part at a time, and only documents with hits are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as X
from .scratch import free, small, written

#: Windows in one broadcast part; each takes some 200 bytes.
BOUND = 200_000


def _lookup(rows: list[tuple[str | None, int, bytes]]) -> dict[int, tuple[np.ndarray, list[list[tuple[bytes, list[str | None]]]]]]:
    """By window length: sorted distinct hashes and, for each, the windows' words with their items."""
    by: dict[int, dict[int, dict[bytes, set]]] = {}
    for item, k, text in rows:
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = X.words(data, np.array([0, len(data)]), X.ALNUM)
        h = int(X.ngram_hashes(X.word_hashes(data, starts, ends), k)[0])
        by.setdefault(k, {}).setdefault(h, {}).setdefault(text, set()).add(item)
    out = {}
    for k, found in by.items():
        keys = np.array(sorted(found), dtype=X.U64)
        out[k] = keys, [[(text, sorted(items, key=str)) for text, items in sorted(found[int(h)].items())] for h in keys]
    return out


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            data, offsets = X.column_bytes(batch.column(1))
            starts, ends, at = X.words(data, offsets, X.ALNUM)
            low = X.ALNUM[1][data]
            ids, lengths, texts = [], [], []
            for i, item in enumerate(batch.column(0).to_pylist()):
                own = [low[a:b].tobytes() for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], strict=True)]
                k = min(size, len(own))
                for j in range(len(own) - k + 1 if k else 0):
                    ids.append(item)
                    lengths.append(k)
                    texts.append(b" ".join(own[j : j + k]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lengths, pa.int32()), pa.array(texts, pa.binary())], names=["item", "k", "words"])

    return run


class Marks:
    """The words of a batch's texts and those that known windows hit."""

    def __init__(self, texts: pa.Array, table) -> None:
        self.data, self.offsets = X.column_bytes(texts)
        self.starts, self.ends, self.at = X.words(self.data, self.offsets, X.ALNUM)
        low = X.ALNUM[1][self.data]
        hashes = X.word_hashes(low, self.starts, self.ends)
        steps = np.zeros(len(self.starts) + 1, np.int64)
        self.items: dict[int, set] = {}
        for k, (keys, known) in table.items():
            grams = X.ngram_hashes(hashes, k)
            if not len(grams):
                continue
            where = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            found = np.flatnonzero(keys[where] == grams)
            doc = np.searchsorted(self.at, found, side="right") - 1
            inside = found + k <= self.at[doc + 1]
            for i, d in zip(found[inside].tolist(), doc[inside].tolist(), strict=True):
                text = b" ".join(low[a:b].tobytes() for a, b in zip(self.starts[i : i + k], self.ends[i : i + k], strict=True))
                for known_text, of in known[where[i]]:
                    if known_text == text:
                        steps[i] += 1
                        steps[i + k] -= 1
                        self.items.setdefault(d, set()).update(of)
        self.hit = np.cumsum(steps)[:-1] > 0

    def places(self, i: int) -> np.ndarray:
        """Indices of a text's hit words."""
        return np.flatnonzero(self.hit[self.at[i] : self.at[i + 1]]).astype(np.int32) if i in self.items else np.zeros(0, np.int32)

    def spans(self, i: int) -> np.ndarray:
        """Byte ranges (start, end, start, end ...) of runs of a text's hit words."""
        own = self.places(i)
        if not len(own):
            return np.zeros(0, np.int64)
        cut = np.flatnonzero(np.diff(own) > 1)
        first, last = own[np.r_[0, cut + 1]] + self.at[i], own[np.r_[cut, len(own) - 1]] + self.at[i]
        return np.stack([self.starts[first], self.ends[last]], 1).ravel() - self.offsets[i]


def _scan(lookup, hits_only: bool):
    """(doc_id, tkey, n_words, hit words' indices, their byte ranges in runs, items) for each document, or for those with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            marks = Marks(batch.column(2), lookup.value)
            rows = sorted(marks.items) if hits_only else range(batch.num_rows)
            lists = [pa.array([f(i) for i in rows], pa.list_(kind)) for f, kind in ((marks.places, pa.int32()), (marks.spans, pa.int64()))]
            items = pa.array([sorted(x for x in marks.items.get(i, ()) if x is not None) for i in rows], pa.list_(pa.string()))
            keep = [batch.column(j).take(pa.array(rows, pa.int64())) if hits_only else batch.column(j) for j in range(2)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(marks.at)[list(rows)], pa.int64()), *lists, items], names=["doc_id", "tkey", "n_words", "places", "spans", "items"])

    return run


def _parts(benchmark: DataFrame, size: int, bound: int) -> list[DataFrame]:
    """The benchmark's distinct windows with their items, in parts of about ``bound`` of them; windows of the same words stay together."""
    slim = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = written(slim.mapInArrow(_item_windows(size), "item string, k int, words binary").distinct(), "windows")
    n = max(1, -(-windows.count() // bound))
    return [windows.where(F.pmod(F.xxhash64("words"), F.lit(n)) == i) for i in range(n)] if n > 1 else [windows]


def _sent(part: DataFrame):
    """A part as a broadcast lookup."""
    return part.sparkSession.sparkContext.broadcast(_lookup([tuple(r) for r in part.collect()]))  # ``bound`` rows, about


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, bound: int = BOUND) -> DataFrame:
    """(doc_id, tkey, n_words, places, spans, items) for each row of docs.

    places: indices of hit words; spans: byte ranges (start, end, start, end ...) of runs of
    hit words; items: ids of the items that occur.  A null or empty text has no words and no
    hits; very long texts are scanned whole.  An item with a null or word-less text never occurs; an
    item with a null id hits words but has no id to list; repeated items count once, repeated
    documents keep a row each.  Empty documents give no rows; an empty benchmark hits nothing.  Other
    columns are ignored, whatever their names.
    """
    parts = _parts(benchmark, size, bound)
    slim = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.col("text").cast("string").alias("text"))
    head = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, tkey long, n_words long"
    kind = f"{head}, places array<int>, spans array<long>, items array<string>"
    if len(parts) == 1:
        return slim.mapInArrow(_scan(_sent(parts[0]), hits_only=False), kind)
    hits = None
    for part in parts:
        lookup = _sent(part)
        more = written(slim.mapInArrow(_scan(lookup, hits_only=True), kind), "hits")
        lookup.unpersist()
        hits = more if hits is None else hits.unionByName(more)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            n = np.diff(X.words(*X.column_bytes(batch.column(2)), X.ALNUM)[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "tkey", "n_words"])

    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731 - of one document
    spans = F.flatten(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(1), F.size("spans"), F.lit(2)), lambda i: F.slice("spans", i, 2)))))))
    merged = hits.groupBy(F.col("doc_id").alias("id"), F.col("tkey").alias("key")).agg(every("places").alias("places"), spans.alias("spans"), every("items").alias("items"))
    rows = slim.mapInArrow(counted, head)
    empty = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("places", "array<int>"), ("spans", "array<long>"), ("items", "array<string>"))]
    return rows.join(merged, rows.doc_id.eqNullSafe(merged.id) & (rows.tkey == merged.key), "left").select("doc_id", "tkey", "n_words", *empty)


def without_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the hit words cut out of the text (each run becomes one space); other columns stay as they are.

    found is what ``contamination`` gives of docs; rows are told apart by doc_id and text.
    """
    key, hit_id, hit_key, spans = free(docs.columns, "key", "hit_id", "hit_key", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text, own in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                text, own = text.as_py(), own.as_py()
                if text and own:
                    raw, out, last = text.encode(), [], 0
                    for a, b in sorted(zip(own[::2], own[1::2], strict=True)):
                        if not out or X.ALNUM[0][np.frombuffer(raw[last:a], np.uint8)].any():  # runs with no word between are one
                            out.append(raw[last:a])
                        last = max(last, b)
                    text = b" ".join([*out, raw[last:]]).decode()
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if j == at else batch.column(j) for j in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    docs = docs.withColumn("text", F.col("text").cast("string"))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    hits = found.where("size(spans) > 0").dropDuplicates(["doc_id", "tkey"]).select(F.col("doc_id").alias(hit_id), F.col("tkey").alias(hit_key), F.col("spans").alias(spans))
    return keyed.join(hits, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.col(key) == F.col(hit_key)), "left").select(*docs.columns, spans).mapInArrow(cut, docs.schema)


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, size: int = 10, bound: int = BOUND) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs, as ``contamination`` finds them."""
    found = contamination(docs, benchmark, size, bound)
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("places") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, share: float = 0.0, bound: int = BOUND) -> DataFrame:
    """docs without those whose share of hit words exceeds ``share`` (0: any hit); all columns as they are.

    Nulls, empty and very long texts, repeats, ties and empty tables are as in ``contamination``.
    """
    parts = _parts(benchmark, size, bound)
    if len(parts) == 1:  # rows are judged where they are
        lookup, at_text = _sent(parts[0]), docs.columns.index("text")
        docs = docs.withColumn("text", F.col("text").cast("string"))

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in X.slices(batches):
                marks = Marks(batch.column(at_text), lookup.value)
                n = np.diff(marks.at)
                hit = np.zeros(batch.num_rows, np.int64)
                for i in marks.items:
                    hit[i] = len(marks.places(i))
                yield batch.filter(pa.array((hit == 0) | (hit <= n * share)))

        return docs.mapInArrow(judged, docs.schema)
    key, hit_id, hit_key = free(docs.columns, "key", "hit_id", "hit_key")
    found = contamination(docs, benchmark, size, bound)
    bad = found.where((F.size("places") > 0) & (F.size("places") > F.col("n_words") * share)).select(F.col("doc_id").alias(hit_id), F.col("tkey").alias(hit_key)).distinct()
    bad = small(written(bad, "contaminated"))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.col(key) == F.col(hit_key)), "left_anti").select(*docs.columns)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: sha256 of no ids, for tests.
NO_ITEMS = hashlib.sha256(b"").hexdigest()
