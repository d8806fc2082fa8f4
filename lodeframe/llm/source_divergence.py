"""How far the words of a language's sources diverge, by integer-dictionary encoding.

Terms are counted by (lang, source) with partial sums before they are shuffled; terms in fewer than
``least`` documents of their language go.  The kept terms are dealt in ranges of (lang, term), so a
task holds a stretch of the dictionary.  It cuts the stretch into chunks: each has a sorted array of
terms, rows get their ids there by binary search, and a ``bincount`` over (source, id) gives dense
vectors of counts.  Ids follow the UTF-8 order of terms, so of equal values the smaller id is the smaller
term.  Sums of pairs and the best terms of each chunk are put together by Spark.

A chunk has ``CELLS`` numbers, whatever the number of sources; the sums of pairs that a task holds
have ``SUMS``: a language of more sources is dealt in bands of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum as X
from .scratch import dropped, small, written

#: Words of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: letters and all beyond ASCII.
LETTERS = X.byte_table([x for x in range(0x80) if not (0x41 <= x <= 0x5A or 0x61 <= x <= 0x7A)])
ONE = 1_000_000_000
SLICE, CELLS, SUMS = 4 << 20, 1 << 21, 1 << 24
#: Groups that are sent to all tasks at once; more go by parts of the languages.
GROUPS = 1 << 18


def _unique_terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(index of each word's term, distinct terms); equal terms are found byte by byte."""
    inside = LETTERS[0][data]
    size = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(LETTERS[1][data[inside]])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = pc.fill_null(column, "").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice of texts; a long text, read in stretches, is one document."""
    names = ["lang", "source", "term", "n", "docs"]
    for batch in X.slices(batches, most=SLICE):
        data, offsets = X.column_bytes(batch.column(2))
        lang, langs = _codes(batch.column(0))
        source, sources = _codes(batch.column(1))
        parts = []
        for part, offs, owner in X.stretches(data, offsets, LETTERS[0], SLICE):
            starts, ends, at = X.words(part, offs, LETTERS)
            if not len(starts):
                continue
            term, terms = _unique_terms(part, starts, ends)
            doc = np.repeat(np.arange(len(at) - 1) + owner, np.diff(at))
            pairs, n = np.unique(doc * len(terms) + term, return_counts=True)
            doc, term = np.divmod(pairs, len(terms))
            group = lang[doc] * len(sources) + source[doc]
            keys, where = np.unique(group * len(terms) + term, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, where, n)
            group, term = np.divmod(keys, len(terms))
            l, s = np.divmod(group, len(sources))
            columns = [langs.take(pa.array(l)), sources.take(pa.array(s)), terms.take(pa.array(term)).cast(pa.large_string()).cast(pa.string())]
            parts.append(pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(np.bincount(where), pa.int64())], names=names))
        if len(parts) > 1:  # stretches of one text
            whole = pa.Table.from_batches(parts).group_by(names[:3]).aggregate([("n", "sum"), ("docs", "max")])
            yield from whole.select([*names[:3], "n_sum", "docs_max"]).rename_columns(names).to_batches()
        else:
            yield from parts


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the documents with it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * (count + 1) / total) in whole numbers, for totals below 9.2e15."""
    above = count + 1
    if above.max(initial=0) < 9_000_000_000:
        return 1 + ONE * above // total
    whole, rest = np.divmod(above, total)
    for _ in range(3):  # long division, three digits at a time
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return 1 + whole


def edges_of(terms: pa.Array) -> np.ndarray:
    """Rows whose term is not that of the row before."""
    return np.flatnonzero(pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)) + 1


def tally(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Sums of counts by key; in two halves, as ``bincount`` adds up doubles."""
    low, high = (np.bincount(keys, half, size).astype(np.int64) for half in (counts & 0xFFFFFFFF, counts >> 32))
    return low + (high << 32)


class Stretch:
    """What a task adds up of one language (and band) over its stretch of the dictionary."""

    def __init__(self, sources: list[str], totals: np.ndarray, n_terms: int, band: tuple[int, int], top: int) -> None:
        self.sources, self.top, self.n_terms = sources, top, n_terms
        self.sizes, self.whole = totals + n_terms, int(totals.sum()) + n_terms
        self.first, self.end = band
        self.pairs = np.zeros((len(sources), self.end - self.first), np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in sources]

    def add(self, terms: pa.Array, source: np.ndarray, count: np.ndarray) -> None:
        """A chunk: rows of whole terms, sorted by term."""
        heads = np.r_[0, edges_of(terms)]  # where each term of the sorted array begins
        vocabulary, n = terms.take(pa.array(heads)), len(heads)
        ids = np.searchsorted(heads, np.arange(len(terms)), side="right") - 1
        counts = tally(source * n + ids, count, len(self.sources) * n).reshape(len(self.sources), n)
        p = shares(counts, self.sizes[:, None])
        for s in range(self.first, self.end):
            apart = p - p[s]
            self.pairs[:, s - self.first] += (apart * apart // p[s]).sum(1)
        if self.first == 0:
            self.rank(vocabulary, counts, p)

    def rank(self, vocabulary: pa.Array, counts: np.ndarray, p: np.ndarray) -> None:
        q = shares(counts.sum(0), np.array(self.whole))
        for s in range(len(self.sources)):
            own = np.flatnonzero((counts[s] > 0) & (p[s] > q))
            f = (p[s, own] - q[own]) ** 2 // q[own]
            first = np.lexsort((own, -f))[: self.top]
            texts = vocabulary.take(pa.array(own[first])).to_pylist()
            self.best[s] = sorted([*self.best[s], *zip((-f[first]).tolist(), (t.encode() for t in texts), strict=True)])[: self.top]

    def rows(self, lang: str) -> Iterator[tuple]:
        for s, source in enumerate(self.sources):
            for t in range(self.first, self.end):
                if s != t:
                    yield lang, source, "pair", self.sources[t], int(self.pairs[s, t - self.first])
            for f, term in self.best[s]:
                yield lang, source, "term", term.decode(), -f


def _chunked(sent, top: int, cells: int):
    """Rows sorted by (lang, band, term) as the sums and best terms of this task's stretches."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, now, stretch, held = sent.value, None, None, []

        def chunk(rows: pa.Table) -> None:
            stretch.add(rows.column("term").combine_chunks(), rows.column("place").to_numpy(), rows.column("n").to_numpy())

        def ended() -> Iterator[pa.RecordBatch]:
            if held:
                chunk(pa.Table.from_batches(held))
                held.clear()
            if stretch is not None:
                rows = stretch.rows(now[0])
                while block := [r for _, r in zip(range(1 << 14), rows)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), kind.types, strict=True)], schema=kind)

        for batch in batches:
            band, lang = batch.column("band").to_numpy(), batch.column("lang")
            new = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)]) if batch.num_rows else []
            for a, b in zip(new, [*new[1:], batch.num_rows], strict=True):
                key = lang[int(a)].as_py(), int(band[a])
                if key != now:
                    yield from ended()
                    sources, totals, n_terms, size = groups[key[0]]
                    first = key[1] * size
                    now, stretch = key, Stretch(sources, totals, n_terms, (first, min(first + size, len(sources))), top)
                held.append(batch.slice(a, b - a))
                if sum(r.num_rows for r in held) >= (most := max(1, cells // len(stretch.sources))):
                    rows = pa.Table.from_batches(held).combine_chunks()
                    edges, done = edges_of(rows.column("term").combine_chunks()), 0
                    while True:  # chunks of whole terms, as many as fit, at least one
                        fits = edges[(edges > done) & (edges - done <= most)]
                        later = edges[edges > done]
                        if not len(later) or (len(rows) - done < most):
                            break
                        to = int(fits[-1]) if len(fits) else int(later[0])
                        chunk(rows.slice(done, to - done))
                        done = to
                    held[:] = rows.slice(done).to_batches()
        yield from ended()

    return run


def divergence(docs: DataFrame, least: int = 3, top: int = 200, groups_at_once: int = GROUPS, cells: int = CELLS, sums: int = SUMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from the others, and its telling terms.

    Each lang keeps the terms that at least ``least`` of its documents hold.  Of every group and every
    lang each kept term has p = 1 + floor(10^9 * (count + 1) / (N + V)), with N occurrences of the V kept terms;
    f = floor((p - q)^2 / q), all in whole numbers.  Part ``pair``: for each other source, whose p is q, the
    sum of f.  Part ``term``: kept terms that the group has, with p above the language's q, and f; the
    first ``top``.  Ranks go by value, descending, and by the item's UTF-8 bytes.

    Null text, lang and source count as ''.  A group without kept terms has pairs; a language without
    kept terms has pairs of value 0.  Empty and very long texts (read in stretches) and repeated rows are
    documents as others; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    counts = written(term_counts(docs), "counts")
    term = Window.partitionBy("lang", "term")
    found = counts.repartitionByRange("lang", "term").withColumn("lang_docs", F.sum("docs").over(term)).withColumn("head", F.row_number().over(term.orderBy("source")) == 1)
    kept = written(found.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "head"), "kept")
    dropped(spark, counts)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("head").alias("heads")), ["lang", "source"], "left")
    lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.sum("heads").over(lang), F.lit(0)).alias("n_terms"), F.count("*").over(lang).alias("n_sources"), (F.row_number().over(lang.orderBy("source")) - 1).cast("long").alias("place"))
    groups = written(groups, "groups")
    # A language of S sources takes bands of sums / S sources each; nearly always one.
    size = F.greatest(F.lit(1), F.floor(F.lit(sums) / F.col("n_sources")))
    bands = small(groups.select("lang", "source", "place", F.ceil(F.col("n_sources") / size).cast("int").alias("bands")))
    placed = kept.select("lang", "source", "term", "n").join(bands, ["lang", "source"]).withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    n_parts = max(1, -(-groups.count() // groups_at_once))
    of_part = lambda rows, i: rows.where(F.pmod(F.xxhash64("lang"), F.lit(n_parts)) == i) if n_parts > 1 else rows
    out = None
    for i in range(n_parts):
        sent = spark.sparkContext.broadcast(_sent(of_part(groups.where("n_terms > 0"), i), sums))
        rows = of_part(placed, i).repartitionByRange("lang", "band", "term").sortWithinPartitions("lang", "band", "term").select("lang", "band", "term", "place", "n")
        part = rows.mapInArrow(_chunked(sent, top, cells), "lang string, source string, part string, item string, value long")
        part = written(part, "divergence")
        sent.unpersist()
        out = part if out is None else out.unionByName(part)
    dropped(spark, kept)
    bare = groups.where("n_terms = 0").select("lang", "source")
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = out.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(none)
    terms = out.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(terms)


def _sent(groups: DataFrame, sums: int) -> dict[str, tuple[list[str], np.ndarray, int, int]]:
    """lang -> (sources in order, their totals, kept terms, sources of a band)."""
    out: dict[str, list] = {}
    for r in groups.collect():  # ``groups_at_once`` rows, about
        out.setdefault(r.lang, []).append((r.place, r.source, r.total, r.n_terms))
    return {k: ([s for _, s, _, _ in v], np.array([t for _, _, t, _ in v], np.int64), v[0][3], max(1, sums // len(v))) for k, v in ((k, sorted(v)) for k, v in out.items())}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))
