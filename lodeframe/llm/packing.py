"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

Documents are taken by falling length.  Open bins are ordered by their residual; the search
starts at the least residual that still fits and goes to successors until it finds the
tightest compatible bin.  A bin carries two bitmaps, of the sources and of the duplicate
clusters inside: a document is compatible if neither holds its own bit, so no bin mixes two
documents of one source or two members of one cluster.  A cluster is what a given column says (say,
the components of a near-copy join) or, without one, the exact copies of a text.  Where no bin is
compatible, a new one opens.

Documents are dealt to independent shards by a hash of their identity, so a source or cluster
of any size is spread over all shards, and a shard's rows are bounded by ``shard_rows`` in
expectation.  Rows that are alike in all that packing sees are counted and numbered, so bins depend
on the rows alone, not on how files are split.  A document longer than the capacity fills bins of its own with whole pieces;
its rest is packed like a document.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written


@dataclass(frozen=True)
class Packing:
    """capacity: words of a bin; shard_rows: documents that one task packs, about."""

    capacity: int = 2048
    shard_rows: int = 4096
    one_of_source: bool = True


class Bins:
    """Open bins by residual.  ``fits`` has bit r set where some bin has the residual r, so the successor of a length is a bit scan.

    Bins of one residual are kept by their pair of bitmaps: bins that look alike are tried once.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.fits = 0
        self.by_residual: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.n = 0

    def _put(self, residual: int, maps: tuple[int, int], number: int) -> None:
        if residual > 0:
            self.by_residual.setdefault(residual, {}).setdefault(maps, []).append(number)
            self.fits |= 1 << residual

    def add(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a document; source and cluster are bitmaps of one bit, or 0 for none."""
        above = self.fits >> length
        residual = length
        while above:
            step = (above & -above).bit_length() - 1
            residual += step
            kinds = self.by_residual[residual]
            for maps, numbers in kinds.items():
                if not (maps[0] & source or maps[1] & cluster):
                    number = numbers.pop(0)
                    if not numbers:
                        del kinds[maps]
                        if not kinds:
                            del self.by_residual[residual]
                            self.fits &= ~(1 << residual)
                    self._put(residual - length, (maps[0] | source, maps[1] | cluster), number)
                    return number, self.capacity - residual
            above >>= step + 1
            residual += 1
        self.n += 1
        self._put(self.capacity - length, (source, cluster), self.n - 1)
        return self.n - 1, 0


def pack_frame(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack rows (doc_id, tkey, source, cluster, copy, length); gives bin, piece, start and n for each piece of each row."""
    rows = rows.sort_values(["length", "doc_id", "tkey", "source", "cluster", "copy"], ascending=[False, True, True, True, True, True], kind="stable")
    source_bits = {s: 1 << i for i, s in enumerate(rows["source"].dropna().unique())}
    sizes = rows["cluster"].value_counts()
    cluster_bits = {c: 1 << i for i, c in enumerate(sizes.index[sizes > 1])}  # a cluster's only member conflicts with nothing
    bins, out, rest = Bins(capacity), [], []
    for i, length in enumerate(rows["length"].tolist()):
        for piece in range(length // capacity):
            out.append((i, bins.n, piece, 0, capacity))
            bins.n += 1
        if length % capacity:
            rest.append((-(length % capacity), i))
    rest.sort()
    sources, clusters, lengths = rows["source"].tolist(), rows["cluster"].tolist(), rows["length"].tolist()
    for less, i in rest:
        number, at = bins.add(-less, source_bits.get(sources[i], 0), cluster_bits.get(clusters[i], 0))
        out.append((i, number, lengths[i] // capacity, at, -less))
    at = pd.DataFrame(out, columns=["i", "bin", "piece", "bin_offset", "n_words"], dtype="int64")
    picked = rows.iloc[at["i"].to_numpy()].reset_index(drop=True)
    return pd.concat([picked, at.drop(columns="i")], axis=1)


#: Alike rows that one row stands for until they are dealt.
ALIKE = 4096


def packed(docs: DataFrame, rule: Packing = Packing(), cluster: str | None = None) -> DataFrame:
    """A row for each piece of each document: doc_id, tkey, shard, bin, piece, bin_offset, n_words, length.

    Lengths are white-space words of the text.  A null, empty or word-less text has no piece; a very
    long one has a piece for each full bin and one for the rest.  ``cluster`` names a column of
    cluster ids, without which equal texts are a cluster.  Documents with a null source or cluster
    conflict with none.  Repeated rows are members of one cluster and so go to different bins; ties in
    length go by doc_id (nulls last), then by a hash of the text, source, cluster and number.  An empty
    table gives no rows; other columns are ignored, whatever their names.  Bins are numbered within
    their shard.
    """
    text = F.col("text").cast("string")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("tkey"),
        (F.col("source") if rule.one_of_source else F.lit(None)).cast("string").alias("source"),
        (F.xxhash64(text) if cluster is None else F.when(F.col(cluster).isNotNull(), F.xxhash64(cluster))).alias("cluster"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("length"),
    ).where("length > 0")
    alike = written(slim.groupBy(*slim.columns).agg(F.count("*").alias("n")), "lengths")
    shards = max(1, -(-(alike.agg(F.sum("n")).first()[0] or 0) // rule.shard_rows))
    # A row that stands for many is split and spread first, so no task writes out a large group.
    many = alike.where(F.col("n") > ALIKE).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ALIKE).cast("long")))).repartition("tkey", "from")
    split = alike.where(F.col("n") <= ALIKE).withColumn("from", F.lit(0).cast("long")).unionByName(many)
    copies = split.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + ALIKE, "n") - 1)))
    dealt = copies.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tkey", "copy"), F.lit(shards)).cast("int"))
    columns = ["doc_id", "tkey", "bin", "piece", "bin_offset", "n_words", "length"]
    capacity = rule.capacity

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = pack_frame(rows, capacity)[columns]
        return out.assign(shard=key[0], doc_id=out["doc_id"].astype("Int64"))

    kind = "doc_id long, tkey long, bin long, piece long, bin_offset long, n_words long, length long, shard int"
    return dealt.drop("n", "from").groupBy("shard").applyInPandas(run, kind).select("doc_id", "tkey", "shard", "bin", "piece", "bin_offset", "n_words", "length")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
