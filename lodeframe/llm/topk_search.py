"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are turned to principal axes, fitted on a bounded sample, and cut into segments; of each
segment the mean and the deviation are kept.  By Cauchy-Schwarz on the deviations, the inner
product of two vectors is at most
``sum over segments of n * (mean_q * mean_x + dev_q * dev_x)``: the distance it stands for has a
lower bound.  Coarse segments are tried first, finer ones for the pairs that remain (at a fine level
the strong axes are segments by themselves, whose deviation is zero), and only the survivors'
products are computed from the integer vectors.  Turning keeps inner products, so bounds hold up to
rounding, for which they get slack.

Queries are dealt to blocks of a bounded number by hash; a block is broadcast and compared with all
rows in one scan.  Before, a scan of a hash-chosen share of the rows gives each query of the block a
score that its k-th best reaches at least; everything under it is pruned, and a task raises it by
the rows it sees.  It only prunes: the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import dropped, fresh, written


@dataclass(frozen=True)
class SearchRule:
    """block: queries in one broadcast, about; sample: least rows that set the first thresholds, and ``share`` the part of all rows.

    axes: rows that principal axes are fitted on, at most; vectors of more than ``turned`` components keep
    their own axes.  cells: pairs that are compared at once.  numbers: components of a broadcast's
    queries, of the rows fitted on, and, a sixteenth, of rows compared at once; wide vectors make these fewer.
    levels: of each resolution, the part of the axes that are segments by themselves, and the segments of
    the rest.  sparse: pairs are looked up one by one where fewer than this part of them is left, else
    a whole matrix product finds all.
    """

    k: int = 5
    every: int = 50
    scale: int = 256
    block: int = 16384
    sample: int = 8192
    share: int = 1024
    axes: int = 8192
    turned: int = 1024
    cells: int = 1 << 21
    numbers: int = 1 << 24
    sparse: float = 1 / 24
    levels: tuple[tuple[float, int], ...] = ((0.4, 6), (0.8, 4))


def quantised(batch: pa.RecordBatch, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors) by length of the vectors that are whole and finite."""
    column = batch.column(1)
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (lengths > 0) & (bad[ends] == bad[ends - np.maximum(lengths, 0)]) & pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
    out = []
    for length in np.unique(lengths[good]):
        own = np.flatnonzero(good & (lengths == length))
        out.append((own, np.floor(scale * values[(ends - lengths)[own][:, None] + np.arange(length)])))
    return out


def cuts(length: int, level: tuple[float, int]) -> np.ndarray:
    """Where the segments of a level begin and end."""
    single = int(length * level[0])
    rest = length - single
    return np.concatenate([np.arange(single), single + np.linspace(0, rest, min(level[1], rest) + 1).astype(int)])


def statistics(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Columns sqrt(n) * mean and sqrt(n) * deviation of the segments: products of two such rows bound products of the vectors."""
    n = np.diff(bounds)
    sums = np.add.reduceat(x, bounds[:-1], axis=1)
    means = sums / np.sqrt(n)
    if n.max() == 1:
        return means
    at = int(np.argmax(n > 1))  # single axes come first
    first = bounds[at]
    squares = np.add.reduceat(x[:, first:] ** 2, bounds[at:-1] - first, axis=1)
    return np.concatenate([means, np.sqrt(np.maximum(squares - means[:, at:] ** 2, 0))], 1)


class Block:
    """Queries of one length with what is known of each one's k-th best score, and the best rows seen."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, axes: np.ndarray | None, rule: SearchRule) -> None:
        self.ids, self.x, self.floor, self.axes, self.k, self.sparse = ids, x, floor.copy(), axes, rule.k, rule.sparse
        self.bounds = [cuts(x.shape[1], level) for level in rule.levels]
        self.levels = self.segments(x)
        self.length = np.sqrt((x * x).sum(1))
        self.score = [np.zeros(0)] * len(ids)
        self.vec = [np.zeros(0, np.int64)] * len(ids)
        self.rows = max(1, min(rule.cells // max(1, len(ids)), rule.numbers // 16 // x.shape[1]))
        #: Pairs that came to each level and, last, to exact products.
        self.pairs = np.zeros(len(self.levels) + 1, np.int64)

    def segments(self, x: np.ndarray) -> list[np.ndarray]:
        turned = x if self.axes is None else x @ self.axes
        return [statistics(turned, b) for b in self.bounds]

    def products(self, mine: np.ndarray, other: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Products of pairs of rows: from one matrix product while many pairs are left, else pair by pair."""
        if len(i) > self.sparse * len(mine) * len(other):
            return (mine @ other.T)[i, j]
        out = np.empty(len(i))
        step = max(1, (1 << 20) // mine.shape[1])
        for at in range(0, len(i), step):
            np.einsum("ij,ij->i", mine[i[at : at + step]], other[j[at : at + step]], out=out[at : at + step])
        return out

    def meet(self, y: np.ndarray, ids: np.ndarray) -> None:
        levels = self.segments(y)
        least = self.floor - 1e-9 * (self.length * np.sqrt((y * y).sum(1).max()) + 1)
        upper = self.levels[0] @ levels[0].T
        self.pairs[0] += upper.size
        i, j = np.nonzero(upper >= least[:, None])
        for n, (mine, other) in enumerate(zip(self.levels[1:], levels[1:], strict=True), 1):
            self.pairs[n] += len(i)
            stays = self.products(mine, other, i, j) >= least[i]
            i, j = i[stays], j[stays]
        self.pairs[-1] += len(i)
        score = self.products(self.x, y, i, j)
        good = (score >= self.floor[i]) & (ids[j] != self.ids[i])
        i, j, score = i[good], j[good], score[good]
        ends = np.searchsorted(i, np.unique(i), side="right")
        for a, b in zip(np.r_[0, ends[:-1]] if len(ends) else ends, ends, strict=True):  # queries that found a better row
            self._keep(int(i[a]), score[a:b], ids[j[a:b]])

    def _keep(self, i: int, score: np.ndarray, vec: np.ndarray) -> None:
        score, vec = np.concatenate([self.score[i], score]), np.concatenate([self.vec[i], vec])
        best = np.lexsort((vec, -score))[: self.k]
        self.score[i], self.vec[i] = score[best], vec[best]
        if len(best) == self.k:
            self.floor[i] = max(self.floor[i], score[best[-1]])

    def best(self) -> pa.RecordBatch:
        n = np.array([len(s) for s in self.score], np.int64)
        empty = [np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate(self.vec or empty).astype(np.int64)), pa.array(np.concatenate(self.score or empty).astype(np.int64))], names=["query_id", "vec_id", "score"])


def _search(block, rule: SearchRule, report: bool = False):
    """Each query's best rows of a stretch of rows, (query_id, vec_id, score), or the pairs at each level, (level, pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {x.shape[1]: Block(ids, x, floor, axes, rule) for ids, x, floor, axes in block.value}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for own, vectors in quantised(batch, rule.scale):
                b = blocks.get(vectors.shape[1])
                for at in range(0, len(own), b.rows if b else 1) if b else ():
                    b.meet(vectors[at : at + b.rows], ids[own[at : at + b.rows]].astype(np.int64))
        for b in blocks.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(b.pairs))), pa.array(b.pairs)], names=["level", "pairs"]) if report else b.best()

    return run


def principal_axes(sampled: DataFrame, rule: SearchRule) -> dict[int, np.ndarray]:
    """By length of vectors, up to ``turned``, the axes of a bounded sample, strongest first."""
    rows = sampled.where(F.size("embedding") <= rule.turned).limit(rule.axes).toArrow().combine_chunks()
    axes: dict[int, np.ndarray] = {}
    for batch in rows.to_batches():
        for _, x in quantised(batch, rule.scale):
            moments = axes.get(x.shape[1], 0) + x.T @ x
            axes[x.shape[1]] = moments
    return {n: np.linalg.eigh(m)[1][:, ::-1].copy() for n, m in axes.items()}


def _blocks(vectors: DataFrame, rule: SearchRule):
    """(written queries by block, number of blocks, written sample, all rows)."""
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = slim.where(F.col("vec_id") % rule.every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = F.col("vec_id") % rule.every == 0
    counts = slim.agg(F.count("*").alias("rows"), F.count_if(asked).alias("queries"), F.coalesce(F.sum(F.when(asked & (F.size("embedding") > 0), F.size("embedding").cast("long"))), F.lit(0)).alias("numbers")).first()
    n = max(1, -(-counts["queries"] // rule.block), -(-counts["numbers"] // rule.numbers))
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")), "queries", ["block"])
    part = max(1, counts["rows"] // max(rule.sample, counts["rows"] // rule.share))
    sampled = written(slim.where(F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(part)) == 0), "sample")
    return slim, queries, n, sampled


def _scans(vectors: DataFrame, rule: SearchRule):
    """Of each block of queries, its broadcast with thresholds that the sample sets, and the rows to scan."""
    spark = vectors.sparkSession
    slim, queries, n, sampled = _blocks(vectors, rule)
    axes = principal_axes(sampled, rule)
    for number in range(n):  # a bounded number of rows reaches the driver at once
        rows = queries.where(F.col("block") == number).select("vec_id", "embedding").toArrow().combine_chunks()
        block = []
        for batch in rows.to_batches():
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            block += [(ids[own].astype(np.int64), x, axes.get(x.shape[1])) for own, x in quantised(batch, rule.scale)]
        if not block:
            continue
        block = [(np.concatenate([b[0] for b in block if b[1].shape[1] == d]), np.concatenate([b[1] for b in block if b[1].shape[1] == d]), axes.get(d)) for d in sorted({b[1].shape[1] for b in block})]
        first = sampled.mapInArrow(_search(spark.sparkContext.broadcast([(i, x, np.full(len(i), -1e300), a) for i, x, a in block]), rule), FOUND)
        seen = {r[0]: r[1] for r in _ranked(first, rule.k).where(F.col("rank") == rule.k).select("query_id", "score").collect()}  # a row a query of the block
        yield slim, spark.sparkContext.broadcast([(i, x, np.array([seen.get(int(v), -1e300) for v in i], float), a) for i, x, a in block])
    dropped(spark, queries, sampled)


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, rule: SearchRule = SearchRule()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows of other
    ids.  Components become floor(scale * x).  A vector that is null, empty or holds a null or
    non-finite component takes no part, nor does a row with a null vec_id.  Vectors of different
    lengths are not compared; very long ones keep their own axes and go in smaller blocks.  Of rows that repeat a query's id
    the smallest vector (by array order) is the query; repeated candidates keep a place each.  An
    empty table gives no rows; other columns are ignored.  Products are exact while they stay under
    2**53.
    """
    spark, folder = vectors.sparkSession, fresh(vectors.sparkSession, "best")
    kind = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], kind).write.parquet(folder)
    for rows, block in _scans(vectors, rule):  # each block's rows join the table when its scan is done
        _ranked(rows.mapInArrow(_search(block, rule), FOUND), rule.k).write.mode("append").parquet(folder)
        block.unpersist()
    return spark.read.schema(kind).parquet(folder)


def surviving(vectors: DataFrame, rule: SearchRule = SearchRule()) -> list[int]:
    """Pairs that a search compares at each level, coarse to fine, and at last by exact products."""
    total = np.zeros(len(rule.levels) + 1, np.int64)
    for rows, block in _scans(vectors, rule):
        for r in rows.mapInArrow(_search(block, rule, report=True), "level long, pairs long").groupBy("level").agg(F.sum("pairs").alias("pairs")).collect():  # a row a level
            total[r["level"]] += r["pairs"]
    return total.tolist()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
