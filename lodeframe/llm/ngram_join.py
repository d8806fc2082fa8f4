"""N-gram Jaccard self-join: a size-aware, heavy-light set join.

A document's set holds the hashes of its distinct word n-grams.  Sets are ordered by rarity
(estimated document frequency, then hash), so that two sets that reach the threshold share
elements near the front of both orders:

* light sets (small): every 2-element subset of a short prefix is a key; two small sets that
  reach the threshold share at least one such subset;
* heavy sets (large): the elements of a prefix are keys of inverted lists, which are scanned;
* the boundary between both is the size that minimises the estimated cost over the histogram
  of set sizes.

Equal sets are one node.  Each inverted list first links its members to one leader; lists
whose members then share a component are done, and only pairs of different components are
compared otherwise: pairs of short lists by a join, those of long lists in blocks of members, of
which only pairs come out that their sketches admit.  So a group of thousands of near copies costs
a row or two a member, yet no link between different components is lost.  Candidates are filtered by sizes and positions
(an exact bound of the overlap), by 1,024-bit parity sketches (an exact bound of the difference)
and verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as X
from .components import connected_components
from .scratch import dropped, free, joined_apart, small, written


@dataclass(frozen=True)
class JaccardJoin:
    """Threshold num/den on |x & y| / |x | y|; shingles of ``words`` words.

    ``heavy_entries`` bounds the broadcast table of frequent shingles, which only orders sets:
    its size never changes the result.  ``broadcast_rows`` bounds another one.  ``scan_cost``: what scanning a list costs, in emitted keys.
    ``short``: members of a list whose pairs are joined; ``block``: members of longer ones that are compared at once.
    """

    words: int = 4
    num: int = 85
    den: int = 100
    heavy_entries: int = 1 << 19
    broadcast_rows: int = 1 << 19
    scan_cost: float = 4.0
    short: int = 64
    block: int = 1024

    def overlap(self, a: int) -> int:
        """The least overlap of a set of a elements with any partner: its own size times the threshold."""
        return -(-self.num * a // self.den)

    def difference(self, n: np.ndarray) -> np.ndarray:
        """The most elements that only one of two linked sets of n elements together may hold."""
        return n - 2 * -(-self.num * n // (self.num + self.den))


def shingle_sets(batch: pa.RecordBatch, rule: JaccardJoin, column: str = "text") -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = X.column_bytes(batch.column(batch.schema.get_field_index(column)))
    starts, ends, at = X.words(data, offsets, X.SPACED)
    hashes = X.word_hashes(data, starts, ends, X.SPACED[1])
    out = []
    for i in range(batch.num_rows):
        own = hashes[at[i] : at[i + 1]]
        out.append(np.unique(X.ngram_hashes(own, min(rule.words, len(own)))) if len(own) else own)
    return out


def _node(s: np.ndarray) -> bytes | None:
    """128 bits that stand for a set."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        a = X.mix(s).sum(dtype=X.U64)
        b = X.mix(s ^ X.U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=X.U64) + X.U64(len(s))
    return np.array([a, b], dtype=X.U64).tobytes()


#: Bits of a set's sketch: bit i is the parity of how many elements fall on i.
SKETCH = 1024


def _sketch(s: np.ndarray) -> bytes:
    return np.packbits(np.bincount((s >> X.U64(24) & X.U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def _first_pass(rule: JaccardJoin):
    """A row for each document, and rows (shingle, count) for shingles that a stretch of documents repeats."""
    most = 1 << 22

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held = 0

        def counted() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values.sort()
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            counts = np.diff(np.append(first, len(values)))
            often = counts > 1
            values, n = values[first], int(often.sum())
            none, blank = pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())
            return pa.RecordBatch.from_arrays([none, none, none, blank, blank, pa.array(X.signed(values[often])), pa.array(counts[often])], names=names)

        names = ["doc_id", "tkey", "n", "node", "sketch", "shingle", "count"]
        for batch in X.slices(batches):
            sets = shingle_sets(batch, rule)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.binary()), pa.array([_sketch(s) for s in sets], pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
            held += sets
            n_held += sum(map(len, sets))
            if n_held > most:
                yield counted()
                n_held = 0
        if n_held:
            yield counted()

    return run


def _prefix_pass(rule: JaccardJoin, boundary: int, heavy):
    """For each document with a set that can have another partner: node, size, keys and their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = heavy.value
        for batch in X.slices(batches):
            nodes, sizes, keys, places = [], [], [], []
            for s in shingle_sets(batch, rule):
                n = len(s)
                if n < 2 or n * (rule.den - rule.num) < rule.num:  # no other set can be near enough
                    continue
                frequency = np.zeros(n, np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    frequency = np.where(often[at] == s, counts[at], 0)
                spare = n - rule.overlap(n)
                first = min(spare + 2, n)
                order = np.lexsort((s, frequency))[:first] if n < 4 * first else _front(s, frequency, first)
                front = s[order]
                key, place = [], []
                if n < boundary:
                    i, j = np.triu_indices(len(front), 1)
                    key.append(X.mix(front[i] * X.U64(0x9E3779B97F4A7C15) + front[j]))
                    place.append(j - 1)
                if n * rule.den >= boundary * rule.num:
                    key.append(front[: spare + 1])
                    place.append(np.arange(min(spare + 1, len(front))))
                nodes.append(_node(s))
                sizes.append(n)
                keys.append(X.signed(np.concatenate(key)))
                places.append(np.concatenate(place).astype(np.int32))
            if nodes:
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places)))], names=["node", "n", "keys", "places"]
                )

    return run


def _front(s: np.ndarray, frequency: np.ndarray, first: int) -> np.ndarray:
    """The first positions in the order (frequency, hash) of a sorted set."""
    rare = np.flatnonzero(frequency == 0)
    if len(rare) >= first:
        return rare[:first]
    rest = np.flatnonzero(frequency)
    rest = rest[np.lexsort((s[rest], frequency[rest]))]
    return np.concatenate([rare, rest[: first - len(rare)]])


def boundary_of(histogram: dict[int, int], rule: JaccardJoin) -> int:
    """The size from which on sets are heavy: least estimated cost over a histogram of sizes."""
    sizes = sorted(histogram)

    def spare(n: int) -> int:
        return n - rule.overlap(n)

    def cost(b: int) -> float:
        light = sum(histogram[n] * (spare(n) + 2) * (spare(n) + 1) / 2 for n in sizes if n < b)
        return light + sum(histogram[n] * (spare(n) + 1) * (1 + rule.scan_cost) for n in sizes if n * rule.den >= b * rule.num)

    return min([0, *(8 << i for i in range(8)), *(12 << i for i in range(7))], key=lambda b: (cost(b), b))


def _floor(counted: DataFrame, entries: int) -> int:
    """The least count (a power of 2, 4 or more) that at most ``entries`` shingles reach."""
    by = {int(r[0]): r[1] for r in counted.groupBy(F.floor(F.log2("c"))).count().collect()}
    i = max(by, default=2)
    reached = by.get(i, 0)
    while i > 2 and reached + by.get(i - 1, 0) <= entries:
        i -= 1
        reached += by.get(i, 0)
    return 1 << (i if reached <= entries else i + 1)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), F.col(text).cast("string").alias("text"))


def _verified(pairs: DataFrame, docs: DataFrame, where: DataFrame, rule: JaccardJoin) -> DataFrame:
    """The pairs of nodes (a, b) behind pairs of ids (x, y) whose whole sets reach the threshold."""
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sketches that differ in more bits than sets of these sizes may differ in elements rule a pair out."""
        for batch in batches:
            sketches = [np.frombuffer(b"".join(batch.column(i).to_pylist()), X.U64).reshape(-1, SKETCH // 64) for i in (4, 5)]
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            differ = np.bitwise_count(sketches[0] ^ sketches[1]).sum(1, dtype=np.int64)
            keep = differ <= rule.difference(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep))

    part = where.select("id", "n", "sketch")
    pairs = written(pairs.join(part.toDF("x", "n1", "s1"), "x").join(part.toDF("y", "n2", "s2"), "y").select("x", "y", "n1", "n2", "s1", "s2").mapInArrow(close, "x long, y long"), "close")
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).distinct()
    needed = written(where.join(ids, "id"), "needed")
    wanted = small(needed.select("rep_id", "rep_key"), rule.broadcast_rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            sets = shingle_sets(batch, rule)
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "elements"])

    texts = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.rep_id) & (docs.tkey == wanted.rep_key), "left_semi").select("text")
    sets = written(texts.mapInArrow(whole, "node binary, elements binary").dropDuplicates(["node"]).select(F.xxhash64("node").alias("id"), "node", "elements"), "sets")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), X.U64), np.frombuffer(y.as_py(), X.U64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(rule.den * common >= rule.num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    met = pairs.join(sets.toDF("x", "a", "s"), "x").join(sets.toDF("y", "b", "t"), "y").where("a <> b").select("a", "b", "s", "t")
    out = written(met.mapInArrow(near, "a binary, b binary"), "links")
    dropped(docs.sparkSession, sets, needed)
    return out


def _pairs_of_long_lists(lists: DataFrame, sizes: DataFrame, where: DataFrame, rule: JaccardJoin) -> DataFrame:
    """(x, y) of members of long lists that sizes, components and sketches admit.

    lists: key, id, n, c; sizes: key, m (members).  A list is dealt to m / block buckets, and each pair of
    buckets is a group of its own of some 2 x block members, so no task meets a whole list.
    """
    buckets = F.ceil(F.col("m") / rule.block).cast("int")
    dealt = lists.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id", "key"), buckets).cast("int"))
    dealt = dealt.join(where.select("id", "sketch"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), buckets - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "id", "n", F.xxhash64("c").alias("c"), "sketch")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, n, c = (rows[k].to_numpy() for k in ("id", "n", "c"))
        sketch = np.frombuffer(b"".join(rows["sketch"]), X.U64).reshape(len(rows), -1)
        side = rows["own"].to_numpy() == key[1]
        here = np.flatnonzero(side)
        there = here if key[1] == key[2] else np.flatnonzero(~side)
        found: list[np.ndarray] = []
        step = max(1, (1 << 18) // max(1, len(there)))
        for at in range(0, len(here), step):
            a = here[at : at + step]
            i, j = np.nonzero((c[a][:, None] != c[there]) & (np.minimum(n[a][:, None], n[there]) * rule.den >= np.maximum(n[a][:, None], n[there]) * rule.num))
            i, j = a[i], there[j]
            for part in range(0, len(i), 1 << 16):
                x, y = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= rule.difference(n[x] + n[y])
                found.append(np.stack([ids[x[near]], ids[y[near]]], 1))
        pairs = np.sort(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=1)
        return pd.DataFrame(pairs[pairs[:, 0] < pairs[:, 1]], columns=["x", "y"])

    return dealt.groupBy("key", "first", "second").applyInPandas(compare, "x long, y long")


def _labelled(docs: DataFrame, rule: JaccardJoin, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tkey, n, label, component_id, n_verified) for every row; label: a set of the row's component, null for the empty set."""
    spark = docs.sparkSession
    base = _keyed(docs, doc_id, text)
    both = written(base.mapInArrow(_first_pass(rule), "doc_id long, tkey long, n long, node binary, sketch binary, shingle long, count long"), "sets")
    rows = both.where("shingle is null").select("doc_id", "tkey", "n", "node")
    counted = written(both.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("c")), "counts")
    frequent = counted.where(F.col("c") >= _floor(counted, rule.heavy_entries)).toPandas()  # at most heavy_entries rows
    often = frequent["shingle"].to_numpy(np.int64).view(X.U64)
    order = np.argsort(often)
    heavy = spark.sparkContext.broadcast((often[order], frequent["c"].to_numpy(np.int64)[order]))
    # Sizes are counted in classes of 4 up to 2048 and as one class beyond: a bounded histogram.
    histogram = {int(r[0]): r[1] for r in rows.where("n > 0").groupBy((F.least("n", F.lit(2048)) / 4).cast("long") * 4 + 1).count().collect()}
    boundary = boundary_of(histogram, rule)

    short = base.mapInArrow(_prefix_pass(rule, boundary, heavy), "node binary, n long, keys array<long>, places array<int>")
    one = written(short.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("places").alias("places")).select(F.xxhash64("node").alias("id"), "n", "keys", "places"), "prefixes")
    # Lists hold 64-bit ids of nodes; nodes that share an id are told apart when their sets are compared.
    often = one.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    keys = one.select("id", "n", F.explode(F.arrays_zip("keys", "places")).alias("k")).select(F.col("k.keys").alias("key"), "id", F.shiftleft("n", 32).bitwiseOR(F.col("k.places").cast("long")).alias("at"))
    shared = written(keys.join(often, "key").select("key", "id", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("place")), "lists")
    dropped(spark, one)

    def admits(n1: str, p1: str, n2: str, p2: str):
        """An exact bound: what is left of both sets behind the shared key still reaches the least overlap."""
        least = F.ceil((F.col(n1) + F.col(n2)) * F.lit(rule.num) / F.lit(rule.num + rule.den))
        return (F.col(n1) - F.col(p1) >= least) & (F.col(n2) - F.col(p2) >= least) & (F.least(n1, n2) * rule.den >= F.greatest(n1, n2) * rule.num)

    lead = shared.groupBy("key").agg(F.min(F.struct("place", "id", "n")).alias("l")).select("key", F.col("l.id").alias("top"), F.col("l.n").alias("n0"), F.col("l.place").alias("p0"))
    stars = shared.join(lead, "key").where(F.col("id") != F.col("top")).where(admits("n", "place", "n0", "p0")).select(F.least("id", "top").alias("x"), F.greatest("id", "top").alias("y")).distinct()
    by_node = both.where("node is not null").groupBy("node", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey", "sketch")).alias("r"))
    where = written(by_node.select(F.xxhash64("node").alias("id"), "node", "n", F.col("r.doc_id").alias("rep_id"), F.col("r.tkey").alias("rep_key"), F.col("r.sketch").alias("sketch")), "nodes")
    named = where.select("id", "node")
    tried = written(stars, "tried")
    links = _verified(tried, base, where, rule)
    label = connected_components(links)

    # Only lists whose members are not in one component by now can hold a link that matters.
    known = shared.join(named.join(label, "node").select("id", "component"), "id", "left").select("key", "id", "n", "place", F.coalesce(F.col("component"), F.col("id").cast("string").cast("binary")).alias("c"))
    known = written(known, "known")
    sizes = known.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("m")).where("c1 <> c2").select("key", "m")
    sizes = written(sizes, "sizes")
    left = known.join(sizes.where(F.col("m") <= rule.short), "key").drop("m")
    x, y = left.toDF("key", "x", "n1", "p1", "ca"), left.toDF("key", "y", "n2", "p2", "cb")
    pairs = x.join(y, "key").where((F.col("x") < F.col("y")) & (F.col("ca") != F.col("cb")) & admits("n1", "p1", "n2", "p2")).select("x", "y")
    pairs = pairs.union(_pairs_of_long_lists(known.drop("place"), sizes.where(F.col("m") > rule.short), where, rule)).distinct().join(tried, ["x", "y"], "left_anti")
    more = _verified(written(pairs, "pairs"), base, where, rule)
    dropped(spark, shared, known)
    every = links.union(more)
    label = written(connected_components(every), "components")
    heavy.unpersist()

    degree = every.select(F.col("a").alias("node")).union(every.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_verified"))
    # Components are named at distinct sets first, then at documents; very common ones and very common sets are joined apart.
    of_node = written(where.select("node", "rep_id").join(label.join(degree, "node", "left"), "node", "left").withColumn("label", F.coalesce("component", "node")), "labels")
    least = of_node.groupBy("label").agg(F.min("rep_id").alias("component_id"))
    of_node = joined_apart(of_node, least, "label", "node").select("node", "label", "component_id", F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified"))
    every_row = joined_apart(rows, written(of_node, "components"), "node", "doc_id", "tkey")
    return every_row.select("doc_id", "tkey", "n", "label", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified"))


def jaccard_components(docs: DataFrame, rule: JaccardJoin = JaccardJoin(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_verified) for every row of docs.

    component_id is the smallest doc_id that links reach; n_verified counts the links that were
    verified for the row's distinct set: enough of them to connect its component, not all of them.  A null,
    empty or word-less text has the empty set: 0 shingles, linked with nothing, its own
    component.  Repeated rows are rows of the same set and keep a row each.  A row with a null
    doc_id takes part; its component is the smallest non-null doc_id that it reaches, else null.
    An empty table gives an empty result; very long texts are compared whole; sets of equal frequency go
    by hash; other columns are ignored, whatever their names.
    """
    return _labelled(docs, rule, doc_id, text).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_verified")


def one_of_each(docs: DataFrame, rule: JaccardJoin = JaccardJoin(words=5, num=80)) -> DataFrame:
    """The rows of docs without near copies: of each component one row stays.

    It is a row of the smallest doc_id, rows with a null doc_id coming last, then of the smallest hash of
    the text; of rows that repeat both, one stays.  Texts without words are near copies of nothing, so
    all of their rows stay, as do all rows of a table without near copies; an empty table gives none.
    Very long texts are compared whole; columns are kept as they are, whatever their names.
    """
    spark = docs.sparkSession
    parts = written(_labelled(docs, rule), "groups")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    chosen = parts.where("label is not null").groupBy("label").agg(F.min(row).alias("stays"), F.count("*").alias("rows"))
    chosen = written(chosen.where("rows > 1").select("label", "stays"), "chosen")
    odd = joined_apart(parts, chosen, "label", "doc_id", "tkey").where("stays is not null").select("doc_id", "tkey", (row == F.col("stays")).alias("stays"))
    odd = written(odd.groupBy("doc_id", "tkey").agg(F.max("stays").alias("stays"), F.count("*").alias("rows")), "odd")
    key, hit_id, hit_key = free(docs.columns, "key", "hit_id", "hit_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(hit_id)) & (F.col(key) == F.col(hit_key))
    named = lambda rows: small(rows.select(F.col("doc_id").alias(hit_id), F.col("tkey").alias(hit_key)))
    kept = keyed.join(named(odd.where("not stays")), same, "left_anti")
    twice = odd.where("stays and rows > 1")
    dropped(spark, parts)
    if twice.isEmpty():
        return kept.select(*docs.columns)
    repeated = kept.join(named(twice), same, "left_semi").dropDuplicates(["doc_id", key])
    return kept.join(named(twice), same, "left_anti").select(*docs.columns).unionByName(repeated.select(*docs.columns))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
