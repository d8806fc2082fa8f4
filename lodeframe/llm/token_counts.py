"""Token counts of a unigram tokenizer by trie-shared dynamic programming.

The distinct pre-tokens (white-space words behind a word-start mark) of a stretch of text are
inserted in a trie.  The best score of a segmentation of a prefix (the forward score) belongs to
the prefix's trie node, so it is computed once for all pre-tokens that share the prefix, level
by level.  The nodes where pre-tokens end hold their token counts, from which documents' sums
are taken.

Pieces come from a public vocabulary file and are never trained here.  The score of a piece is
the logarithm of its Zipf share by rank; a byte that no piece covers is a token by itself with
a score below all pieces.  Ties in score go to fewer tokens.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as X

MARK = "▁".encode()
#: Pre-tokens of a level that are worth one vector step; below, pre-tokens are walked one by one.
WIDE = 64


@dataclass
class Pieces:
    """Scores of pieces (bytes); ``by_length``: sorted hashes and their scores for each length."""

    scores: dict[bytes, float]
    byte_score: float
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        groups: dict[int, list[tuple[bytes, float]]] = {}
        for piece, score in self.scores.items():
            groups.setdefault(len(piece), []).append((piece, score))
        for length, rows in groups.items():
            data = np.frombuffer(b"".join(p for p, _ in rows), np.uint8)
            starts = np.arange(len(rows)) * length
            hashes = X.RangeHashes(data)(starts, starts + length)
            order = np.argsort(hashes)
            self.by_length[length] = hashes[order], np.array([s for _, s in rows])[order]


def load_pieces(path: str | None = None) -> Pieces:
    """Pieces of a sentencepiece file, control pieces and byte pieces aside; scores by rank."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return ranked_pieces([n.encode() for n in names])


def ranked_pieces(names: list[bytes]) -> Pieces:
    """Piece r (from 1) has the score log(1 / (r * H)), H the harmonic sum over all pieces."""
    harmonic = float(np.log(np.sum(1 / np.arange(1, len(names) + 1)))) if names else 0.0
    scores = {n: -float(np.log(r)) - harmonic for r, n in reversed(list(enumerate(names, 1))) if n}
    return Pieces(scores, min(scores.values(), default=0.0) - 10)


def count_one(token: bytes, pieces: Pieces) -> int:
    """Tokens of one pre-token by plain dynamic programming over its bytes."""
    n = len(token)
    best, count = [0.0] * (n + 1), [0] * (n + 1)
    lengths = sorted(pieces.by_length)
    for t in range(1, n + 1):
        b, c = best[t - 1] + pieces.byte_score, count[t - 1] + 1
        for length in lengths:
            if length > t:
                break
            s = pieces.scores.get(token[t - length : t])
            if s is not None:
                x, m = best[t - length] + s, count[t - length] + 1
                if x > b + 1e-9 or (x > b - 1e-9 and m < c):
                    b, c = x, m
        best[t], count[t] = b, c
    return count[n]


def trie_counts(tokens: list[bytes], pieces: Pieces) -> np.ndarray:
    """Tokens of each of distinct pre-tokens, by one pass over their trie."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    out = np.zeros(len(tokens), np.int64)
    deepest = int(np.partition(lengths, -WIDE)[-WIDE]) if len(tokens) >= WIDE else 0
    _wide_levels(tokens, lengths, deepest, pieces, out)
    _narrow_paths(tokens, np.flatnonzero(lengths > deepest), pieces, out)
    return out


def _narrow_paths(tokens: list[bytes], which: np.ndarray, pieces: Pieces, out: np.ndarray) -> None:
    """Forward scores along the paths of some pre-tokens, depth first: what a path shares with the one before is kept."""
    sizes, scores = sorted(pieces.by_length), pieces.scores
    best, count, before = array("d", [0.0]), array("q", [0]), b""
    for i in sorted(which.tolist(), key=tokens.__getitem__):
        token = tokens[i]
        shared = _shared(before, token)
        del best[shared + 1 :], count[shared + 1 :]
        for t in range(shared + 1, len(token) + 1):
            b, c = best[t - 1] + pieces.byte_score, count[t - 1] + 1
            for size in sizes:
                if size > t:
                    break
                s = scores.get(token[t - size : t])
                if s is not None:
                    x, m = best[t - size] + s, count[t - size] + 1
                    if x > b + 1e-9 or (x > b - 1e-9 and m < c):
                        b, c = x, m
            best.append(b)
            count.append(c)
        out[i], before = count[-1], token


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else ()
    return int(differ[0]) if len(differ) else n


def _wide_levels(tokens: list[bytes], lengths: np.ndarray, deepest: int, pieces: Pieces, out: np.ndarray) -> None:
    """Forward scores of all nodes down to a level, and the counts of pre-tokens that end there."""
    cut = np.minimum(lengths, deepest)
    starts = np.cumsum(cut) - cut
    data = np.frombuffer(b"".join(t[:deepest] for t in tokens), np.uint8)
    # Of every pre-token and depth, the number of its node; nodes of a level are numbered by the hash of the prefix.
    # Only the levels that a piece reaches back to are kept.
    reach = max(pieces.by_length, default=1)
    nodes = {0: np.zeros(len(tokens), np.int64)}
    best, count = {0: np.zeros(1)}, {0: np.zeros(1, np.int64)}
    alive = np.arange(len(tokens))
    hashed = X.RangeHashes(data)
    for depth in range(1, deepest + 1):
        alive = alive[lengths[alive] >= depth]
        _, first, own = np.unique(hashed(starts[alive], starts[alive] + depth), return_index=True, return_inverse=True)
        node = np.full(len(tokens), -1, np.int64)
        node[alive] = own
        nodes[depth] = node
        sample = alive[first]  # a token through each node
        end = starts[sample] + depth
        b = best[depth - 1][nodes[depth - 1][sample]] + pieces.byte_score
        c = count[depth - 1][nodes[depth - 1][sample]] + 1
        for length, (hashes, scores) in pieces.by_length.items():
            if length > depth:
                continue
            h = hashed(end - length, end)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == h)
            if not len(hit):
                continue
            parent = nodes[depth - length][sample[hit]]
            x, m = best[depth - length][parent] + scores[at[hit]], count[depth - length][parent] + 1
            better = (x > b[hit] + 1e-9) | ((x > b[hit] - 1e-9) & (m < c[hit]))
            b[hit[better]], c[hit[better]] = x[better], m[better]
        best[depth], count[depth] = b, c
        ended = alive[lengths[alive] == depth]
        out[ended] = c[node[ended]]
        for level in (nodes, best, count):
            level.pop(depth - reach, None)


#: Most pre-tokens whose counts a worker remembers from one stretch of text to the next.
REMEMBERED = 1 << 20


class Counter:
    """Counts of pre-tokens, remembered from one stretch of text to the next."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.hashes, self.counts = np.zeros(0, X.U64), np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, tokens) of each text."""
        starts, ends, at = X.words(data, offsets, X.SPACED)
        distinct, first, which = np.unique(X.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        old = self.hashes[place] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        counts = np.zeros(len(distinct), np.int64)
        counts[old] = self.counts[place[old]]
        new = np.flatnonzero(~old)
        if len(new):
            counts[new] = trie_counts([MARK + data[starts[i] : ends[i]].tobytes() for i in first[new]], self.pieces)
            if len(self.hashes) + len(new) <= REMEMBERED:
                at_new = np.searchsorted(self.hashes, distinct[new])  # both are sorted, so this merges them
                self.hashes, self.counts = np.insert(self.hashes, at_new, distinct[new]), np.insert(self.counts, at_new, counts[new])
        sums = np.concatenate([[0], np.cumsum(counts[which])])
        return np.diff(at), sums[at[1:]] - sums[at[:-1]]


def _count(pieces, at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces.value)
        for batch in X.slices(batches, most=2 * X.BLOCK):
            sums = np.zeros((2, batch.num_rows), np.int64)
            for data, offsets, first in X.stretches(*X.column_bytes(batch.column(at_text)), X.SPACED[0], 2 * X.BLOCK):
                sums[:, first : first + len(offsets) - 1] += counter(data, offsets)
            keep = [batch.column(j) for j in range(batch.num_columns) if j != at_text]
            names = [n for j, n in enumerate(batch.schema.names) if j != at_text]
            yield pa.RecordBatch.from_arrays([*keep, *map(pa.array, sums)], names=[*names, "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row of docs.

    A null, empty or blank text has no tokens; a very long one is read whole, in stretches between
    pre-tokens.  Repeated rows keep a row each, rows with a null doc_id too; segmentations of equal
    score go by fewer tokens.  An empty table gives no rows; other columns are ignored, whatever their
    names.
    """
    table = docs.sparkSession.sparkContext.broadcast(pieces or load_pieces())
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_count(table, 1), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
