"""The best entries of a lexicon for each text, by one walk down the lexicon's letter tree instead of by pairs.

Texts and lexicon are dealt in blocks of bounded size; each pair of blocks is one task's work.  A walk
keeps, for each text and node of the tree, the least insertions and deletions that turn each beginning
of the text into the node's letters, and leaves a node where no entry below can reach the threshold.  Only
the best few of a block leave the task, so the rows made are a few for each text, however many are near.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Texts and entries of a block, and cells that one step of a walk may hold.
TEXTS, ENTRIES, CELLS = 1 << 14, 1 << 17, 1 << 23
_EPS = 1e-9


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters from 1 and 0 behind a text's end, lengths)."""
    n = np.array([len(t) for t in texts], np.int32)
    codes = np.zeros((len(texts), int(n.max()) + 1), np.int32)
    codes[np.arange(codes.shape[1]) < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32) + 1
    return codes, n


class Tree:
    """The letters of entries as a tree: a level holds each distinct beginning once, in order."""

    def __init__(self, entries: list[str]) -> None:
        codes, n = _letters(entries)
        order = np.lexsort(codes.T[::-1])
        codes, n = codes[order], n[order]
        begun, rows = np.zeros(len(n), bool), np.arange(len(n))
        begun[0] = True
        starts, self.levels = np.array([0]), []
        for p in range(codes.shape[1]):
            alive = n >= p  # entries that still have a letter or their end here
            begun[1:] |= (codes[1:, p] != codes[:-1, p]) | ~alive[:-1]
            nodes = rows[begun & alive]
            children = np.searchsorted(nodes, np.append(starts, len(n)))
            live = lambda ufunc, fill: ufunc.reduceat(np.where(alive, n, fill), nodes) if len(nodes) else n[:0]
            self.levels.append((children, codes[nodes, p], live(np.minimum, np.int32(1 << 30)), live(np.maximum, np.int32(-1)), order[nodes]))
            starts = nodes


def walked(texts: list[str], tree: Tree, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, entry, ratio) of all pairs that reach the threshold, some at a time."""
    codes, n = _letters(texts)
    w = codes.shape[1]
    kind = np.int8 if w + len(tree.levels) < 60 else np.int32
    high, step = np.iinfo(kind).max // 2, np.arange(w, dtype=kind)[:, None]
    most = np.floor(n * (2 - threshold) / threshold + _EPS)  # no longer entry can reach the threshold
    size = max(1, CELLS // w)
    todo = [(0, np.arange(a, min(a + size, len(n))), None, None) for a in range(0, len(n), size)]
    while todo:
        p, who, node, rows = todo.pop()
        if p == len(tree.levels):
            continue
        if rows is None:
            node, rows = np.zeros(len(who), np.int64), np.repeat(step, len(who), axis=1)
        children, letter, least, longest, entry = tree.levels[p]
        many = children[node + 1] - children[node]
        ends = np.cumsum(many)
        if len(who) > 1 and ends[-1] * w > CELLS:
            cut = min(max(1, int(np.searchsorted(ends, ends[-1] // 2))), len(who) - 1)
            todo += [(p, who[cut:], node[cut:], rows[:, cut:]), (p, who[:cut], node[:cut], rows[:, :cut])]
            continue
        back = np.repeat(np.arange(len(who)), many)
        child = np.arange(len(back)) - np.repeat(ends - many - children[node], many)
        own, ch = who[back], letter[child]
        done = ch == 0
        if done.any():
            i, total = own[done], n[own[done]] + p
            apart = rows[n[i], back[done]].astype(np.int64)
            ratio = np.where(total > 0, (total - apart) / np.maximum(total, 1), 1.0)
            good = ratio >= threshold - _EPS
            yield i[good], entry[child[done]][good], ratio[good]
        fits = ~done & (least[child] <= most[own])
        back, child, own, ch = back[fits], child[fits], own[fits], ch[fits]
        if not len(back):
            continue
        before = rows[:, back]
        after = before + kind(1)
        same = codes[own, : w - 1].T == ch
        np.minimum(after[1:], np.where(same, before[:-1], kind(high)), out=after[1:])
        after = np.minimum.accumulate(after - step, axis=0) + step
        left = (n[own] - np.arange(w)[:, None]).astype(kind)  # letters of the text behind; below 0 outside it
        rest_least, rest_most = (least[child] - p - 1).clip(0, high // 2).astype(kind), (longest[child] - p - 1).clip(0, high // 2).astype(kind)
        gap = np.maximum(np.maximum(rest_least - left, left - rest_most), 0)
        bound = np.where(left >= 0, np.minimum(after, kind(high // 2)) + gap, kind(high)).min(axis=0)
        keep = bound <= (1 - threshold) * (n[own] + np.minimum(longest[child], most[own])) + _EPS
        todo.append((p + 1, own[keep], child[keep], after[:, keep]))


def _by_length(texts: list[str]) -> list[np.ndarray]:
    """Places of texts of like length: a long one makes no wide table of short ones."""
    kinds = np.array([len(t).bit_length() for t in texts])
    return [np.flatnonzero(kinds == k) for k in np.unique(kinds)]


def _few(texts: list[str], entries: list[str], order: np.ndarray, threshold: float, k: int, score: Callable | None) -> list[tuple[int, int, float]]:
    """The k best entries of each text of a block, ties to the smaller order; ``score`` is a ratio that is never above that of the walk."""
    best: dict[int, list] = {}
    for e in _by_length(entries):
        tree, high = Tree([entries[x] for x in e]), max(len(entries[x]) for x in e)
        low = min(len(entries[x]) for x in e)
        for t in _by_length(texts):
            t = np.array([x for x in t if len(texts[x]) * threshold <= high * (2 - threshold) + _EPS and low * threshold <= len(texts[x]) * (2 - threshold) + _EPS], int)
            for some in np.array_split(t, len(t) // 1024 + 1) if len(t) else []:
                parts = list(walked([texts[x] for x in some], tree, threshold))
                if not parts:
                    continue
                i, j, r = some[np.concatenate([p[0] for p in parts])], e[np.concatenate([p[1] for p in parts])], np.concatenate([p[2] for p in parts])
                sort = np.lexsort((order[j], -r, i))
                i, j, r = i[sort], j[sort], r[sort]
                if score is None:
                    first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else i
                    keep = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
                    i, j, r = i[keep], j[keep], r[keep]
                for x, y, ratio in zip(i.tolist(), j.tolist(), r.tolist(), strict=True):
                    mine = best.setdefault(x, [])
                    if len(mine) == k and -mine[-1][0] > ratio:
                        continue
                    exact = ratio if score is None else score(texts[x], entries[y])
                    if exact >= threshold:
                        mine.append((-exact, order[y], y))
                        mine.sort()
                        del mine[k:]
    return [(x, y, -less) for x, mine in best.items() for less, _, y in mine]


def best_entries(texts: DataFrame, a: str, lexicon: DataFrame, b: str, threshold: float, k: int = 2, order: str | None = None, score: Callable[[str, str], float] | None = None) -> DataFrame:
    """(a, b, ratio): at most k entries of each distinct text, the best that reach the threshold, ties to the smallest ``order`` (a whole number, one for each distinct entry; else to the smaller entry).

    The ratio is ``indel_ratio``, or ``score``, which must never be above it.  Nulls take no part.
    """
    spark = texts.sparkSession
    one = checkpointed(texts.select(F.col(a).alias("text")).where("text is not null").distinct())
    two = checkpointed(lexicon.select(F.col(b).alias("entry"), (F.col(order) if order else F.lit(0)).cast("long").alias("place")).where("entry is not null").distinct())
    lots, stretches = max(1, ceil(one.count() / TEXTS)), max(1, ceil(two.count() / ENTRIES))
    if stretches > 1:
        two = checkpointed(two.repartitionByRange(stretches, "entry").withColumn("stretch", F.spark_partition_id()))
        stretches = two.agg(F.max("stretch")).first()[0] + 1
    else:
        two = two.withColumn("stretch", F.lit(0))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    l = one.withColumn("lot", F.pmod(F.xxhash64("text"), F.lit(lots)).cast("int")).withColumn("stretch", every(stretches)).repartition(lots * stretches, "lot", "stretch")
    r = two.withColumn("lot", every(lots)).repartition(lots * stretches, "lot", "stretch")

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("place", "ascending"), ("entry", "ascending")])
        mine, entries, place = (c.to_pylist() for c in (left["text"], right["entry"], right["place"]))
        found = _few(mine, entries, np.arange(len(entries)), threshold, k, score) if mine and entries else []
        columns = [[mine[x] for x, _, _ in found], [entries[y] for _, y, _ in found], [place[y] for _, y, _ in found], [z for _, _, z in found]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)], names=["a_", "b_", "place", "ratio"])

    met = l.groupBy("lot", "stretch").cogroup(r.groupBy("lot", "stretch")).applyInArrow(block, "a_ string, b_ string, place long, ratio double")
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("less"), "place", "b_"))), 1, k)  # k of each stretch
    out = met.groupBy("a_").agg(first.alias("x")).select("a_", F.explode("x").alias("x")).select(F.col("a_").alias(a), F.col("x.b_").alias(b), (-F.col("x.less")).alias("ratio"))
    return checkpointed(out)


def tiers(floor: float, steps: int = 3) -> list[float]:
    """Thresholds from near 1 down to the floor: most texts are settled at a high one, where little is near."""
    return [*[1 - (1 - floor) * s / steps for s in range(1, steps)], floor]
