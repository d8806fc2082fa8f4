"""Toxicity: a linear-chain conditional random field tags toxic words, its marginals score documents.

Labelled tokens: labels are of documents, so the words of a bounded sample of labelled
documents are labelled first.  A word of a toxic document is toxic if one of its features (the
word, or its first 3 to 7 bytes) is far more common in toxic than in clean documents by the
log-likelihood ratio; every other word is clean.  On these the field is trained by maximum
likelihood: features' weights for the tag "toxic" and the transitions between tags.

A chain is a sentence (of 64 words at most).  Forward-backward gives each word's probability
of being toxic.  A document's score is a logistic function, fitted on the same sample, of the
sum of its noticeable marginals (``floor`` or more; the sum counts to ``ceiling``) and of their
largest; the words of 0.5 or more are its offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as X
from .substring_dedup import SpanRule, sentences


@dataclass(frozen=True)
class ToxicityRule:
    """sample: toxic documents that the field is fitted on, at most, and twice as many clean ones (the bound of the sample).

    sample_bytes: bytes of all sampled texts; longer ones than fit give random chains, none is left out.
    """

    sample: int = 800
    sample_bytes: int = 8_000_000
    folds: int = 5
    held_out: int = 0
    buckets: int = 1 << 18
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)
    rounds: int = 40
    rate: float = 0.4
    ridge: float = 1e-6
    floor: float = 0.05
    ceiling: float = 6.0


_CHAINS = SpanRule(longest=64)


def _word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: ToxicityRule) -> np.ndarray:
    """Bucket of each feature of each word (words x features); a prefix as long as the word is the word's own bucket."""
    columns = [X.word_hashes(data, starts, ends)]
    columns += [X.word_hashes(data, starts, np.minimum(starts + k, ends)) + X.U64(k) for k in rule.prefixes]
    return np.stack([(c % X.U64(rule.buckets)).astype(np.int64) for c in columns], 1)


@dataclass
class Field:
    """Weights by feature bucket, bias, and scores of transitions from tag to tag (0 clean, 1 toxic)."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    scale: np.ndarray = None  # of the document's logistic: constant, sum of marginals, largest marginal

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(1) + self.bias


class Tokens:
    """The words of texts: distinct words' features, each word's distinct word, and its chain."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: ToxicityRule) -> None:
        self.starts, self.ends, self.at = X.words(data, offsets, X.ALNUM)
        low = X.ALNUM[1][data]
        hashes = X.word_hashes(low, self.starts, self.ends)
        _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        order = np.argsort(first)  # word_hashes takes words in the order of the text
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        first, self.word = first[order], place[word]
        self.features = _word_features(low, self.starts[first], self.ends[first], rule)
        heads = sentences(data, offsets, _CHAINS)[0]
        self.head = np.searchsorted(self.starts, heads)
        self.length = np.diff(np.append(self.head, len(self.starts)))


def marginals(e: np.ndarray, head: np.ndarray, length: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(toxic) of each word, expected counts of moves, and the log partition function, by scaled forward-backward.

    e: score of "toxic" over "clean" of each word; chains start at head and have the given lengths.
    """
    out = np.zeros(len(e))
    counts = np.zeros((2, 2))
    if not len(head):
        return out, counts, 0.0
    order = np.argsort(-length, kind="stable")
    head, length = head[order], length[order]
    n, steps = len(head), int(length[0])
    alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]  # chains longer than t
    x = np.exp(np.clip(e, -30, 30))
    m = np.exp(moves)
    alpha = [np.empty((k, 2)) for k in alive]
    scale = [np.empty(k) for k in alive]
    for t, k in enumerate(alive):
        if t:
            before = alpha[t - 1][:k]
            clean, toxic = before @ m[:, 0], before @ m[:, 1]
        else:
            clean, toxic = np.ones(n), np.ones(n)
        toxic = toxic * x[head[:k] + t]
        scale[t] = clean + toxic
        alpha[t][:, 0], alpha[t][:, 1] = clean / scale[t], toxic / scale[t]
    total = float(sum(np.log(s).sum() for s in scale))
    beta = np.ones((n, 2))
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        out[head[:k] + t] = alpha[t][:, 1] * beta[:k, 1] / (alpha[t] * beta[:k]).sum(1)
        if t:
            ahead = beta[:k].copy()
            ahead[:, 1] *= x[head[:k] + t]
            ahead /= scale[t][:, None]
            counts += np.einsum("ki,ij,kj->ij", alpha[t - 1][:k], m, ahead)
            beta[:k] = ahead @ m.T
    return out, counts, total


def pooled(p: np.ndarray, at: np.ndarray, rule: ToxicityRule) -> np.ndarray:
    """(1, sum, largest) of the noticeable marginals of each document."""
    n = len(at) - 1
    loud = np.flatnonzero(p >= rule.floor)
    doc = np.searchsorted(at, loud, side="right") - 1
    most = np.zeros(n)
    np.maximum.at(most, doc, p[loud])
    return np.stack([np.ones(n), np.minimum(np.bincount(doc, weights=p[loud], minlength=n), rule.ceiling), most], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by ridge-regularised Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - q) - 0.1 * w)
    return w


def _evidence(tokens: Tokens, toxic: np.ndarray, rule: ToxicityRule) -> np.ndarray:
    """For each distinct word: does a feature of it tell toxic documents from clean ones?"""
    doc = np.repeat(np.arange(len(toxic)), np.diff(tokens.at))
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    strong = np.zeros(rule.buckets, bool)
    share = n1 / (n1 + n0)
    for c in range(tokens.features.shape[1]):
        seen, times = np.unique(tokens.features[tokens.word, c] * len(toxic) + doc, return_counts=True)
        for often in (seen, seen[times > 1]):  # documents with the feature, and documents that repeat it
            bucket, of = often // len(toxic), toxic[often % len(toxic)]
            a = np.bincount(bucket[of], minlength=rule.buckets).astype(float)
            b = np.bincount(bucket[~of], minlength=rule.buckets).astype(float)
            n = a + b
            with np.errstate(divide="ignore", invalid="ignore"):
                g = 2 * (np.where(a > 0, a * np.log(a / (n * share)), 0) + np.where(b > 0, b * np.log(b / (n * (1 - share))), 0))
            limit = 2 * (np.log(max(1, (n > 0).sum())) + 3)
            strong |= (g > limit) & (a / n1 > 8 * (b + 0.5) / (n0 + 1))
    return strong[tokens.features].any(1)


def train(texts: list[str | None], toxic: list[int], rule: ToxicityRule) -> Field:
    """Fit the field; without both classes it never fires."""
    y = np.array(toxic, bool)
    field = Field(np.zeros(rule.buckets), -8.0, np.zeros((2, 2)))
    if not y.any() or y.all():
        return field
    data, offsets = X.column_bytes(pa.array(texts, pa.string()))
    keep = _distinct(data, offsets)
    data, offsets = X.column_bytes(pa.array([texts[i] for i in keep], pa.string()))
    y = y[keep]
    tokens = Tokens(data, offsets, rule)
    if not y.any() or y.all() or not len(tokens.word):
        return field
    tag = _evidence(tokens, y, rule)[tokens.word] & np.repeat(y, np.diff(tokens.at))
    inside = np.ones(len(tag), bool)
    inside[tokens.head] = False
    second = np.flatnonzero(inside)
    seen = np.bincount(tag[second - 1].astype(int) * 2 + tag[second], minlength=4).reshape(2, 2)
    n = max(1, len(tag))
    field.bias = float(np.log((tag.sum() + 1) / n))
    params = {"weights": field.weights, "bias": np.array([field.bias]), "moves": field.moves}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second_moment = {k: np.zeros_like(v) for k, v in params.items()}
    for step in range(1, rule.rounds + 1):
        field = Field(params["weights"], float(params["bias"][0]), params["moves"])
        p, counts, _ = marginals(field.emissions(tokens.features)[tokens.word], tokens.head, tokens.length, field.moves)
        residual = np.bincount(tokens.word, weights=tag - p, minlength=len(tokens.features))
        by_feature = np.bincount(tokens.features.ravel(), weights=np.repeat(residual, tokens.features.shape[1]), minlength=rule.buckets)
        gradients = {"weights": by_feature / n - rule.ridge * params["weights"], "bias": np.array([residual.sum() / n]), "moves": (seen - counts) / n}
        for k, g in gradients.items():  # Adam
            first[k] = 0.8 * first[k] + 0.2 * g
            second_moment[k] = 0.95 * second_moment[k] + 0.05 * g * g
            params[k] = params[k] + rule.rate * (first[k] / (1 - 0.8**step)) / (np.sqrt(second_moment[k] / (1 - 0.95**step)) + 1e-7)
    field = Field(params["weights"], float(params["bias"][0]), params["moves"])
    p = marginals(field.emissions(tokens.features)[tokens.word], tokens.head, tokens.length, field.moves)[0]
    field.scale = _logistic(pooled(p, tokens.at, rule), y.astype(float))
    return field


def _distinct(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Texts most of whose 4-word runs no earlier text has: copies would make their own words telling."""
    starts, ends, at = X.words(data, offsets, X.ALNUM)
    hashes = X.word_hashes(data, starts, ends, X.ALNUM[1])
    seen: set[int] = set()
    keep = []
    for i in range(len(offsets) - 1):
        own = hashes[at[i] : at[i + 1]]
        grams = X.ngram_hashes(own, min(4, len(own))) if len(own) else own
        grams = set(grams[grams % X.U64(4) == 0].tolist()) if len(grams) > 16 else set(grams.tolist())
        if not grams or len(grams & seen) * 2 <= len(grams):
            keep.append(i)
            seen |= grams
    return keep


def _allowance(sizes: list[int], most: int) -> int:
    """The largest size to which all texts are cut so that they hold ``most`` bytes together."""
    left, ordered = most, sorted(sizes)
    for i, size in enumerate(ordered):
        share = left // (len(ordered) - i)
        if size > share:
            return max(1, share)
        left -= size
    return max(1, ordered[-1]) if ordered else 1


def _excerpt(text: str, most: int) -> str:
    """The text if it has no more than ``most`` bytes, else those of its chains that fit in, drawn by hash."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    data, offsets = X.column_bytes(pa.array([text], pa.large_string()))
    starts, hashes, _, _ = sentences(data, offsets, _CHAINS)
    if not len(starts):
        return ""
    sizes = np.diff(np.append(starts, len(data))) + 1
    # Each hash is mixed with its place, so that repeats of a chain are drawn apart.
    order = np.argsort(X.mix(hashes + X.mix(np.arange(len(starts), dtype=X.U64))), kind="stable")
    taken, left = [], most
    for i in order.tolist():
        if sizes[i] <= left:
            taken.append(i)
            left -= int(sizes[i])
    if not taken:  # chains without end: the beginning of one
        return raw[starts[order[0]] :][:most].decode(errors="ignore")
    return "\n".join(raw[starts[i] : starts[i] + sizes[i] - 1].decode() for i in sorted(taken))


def _excerpts(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            texts = [_excerpt(x, most) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], names=["doc_id", "text", "toxic"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, rule: ToxicityRule) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of labelled documents outside the held-out fold, by hash order.

    Where the sample's texts hold more than ``sample_bytes``, the longest give random chains only.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(rule.folds))
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != rule.held_out)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    # Copies of one text crowd a sample, so it is drawn from hashes of texts before texts are read.
    slim = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.octet_length(F.col("text").cast("string")).alias("size"))
    both = known.join(slim, "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.max("size").alias("size"))
    picked = None
    for value in (0, 1):
        some = both.where(F.col("toxic") == value).orderBy(F.xxhash64("h"), "h").limit(rule.sample * (2 - value))
        picked = some if picked is None else picked.unionByName(some)
    rows = picked.select("doc_id", "h", "toxic", "size").collect()  # 3 x sample rows at most
    picked = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id, r.h, r.toxic) for r in rows], f"doc_id long, h long, toxic {labels.schema['toxic'].dataType.simpleString()}"))
    # By id and text: an id of several texts gives those that were drawn.
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text")).join(picked, ["doc_id", "h"]).select("doc_id", "text", "toxic")
    return texts.mapInArrow(_excerpts(_allowance([r.size for r in rows], rule.sample_bytes)), texts.schema).dropDuplicates(["doc_id", "text"])


def fitted(docs: DataFrame, labels: DataFrame, rule: ToxicityRule = ToxicityRule()) -> Field:
    rows = training_rows(docs, labels, rule).toPandas().sort_values(["doc_id", "text"])
    return train(rows["text"].tolist(), rows["toxic"].tolist(), rule)


def _score(field, rule: ToxicityRule, at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for batch in X.slices(batches):
            data, offsets = X.column_bytes(batch.column(at_text))
            tokens = Tokens(data, offsets, rule)
            p = marginals(model.emissions(tokens.features)[tokens.word], tokens.head, tokens.length, model.moves)[0] if len(tokens.word) else np.zeros(0)
            if model.scale is None:
                score = np.zeros(batch.num_rows)
            else:
                score = 1 / (1 + np.exp(-np.clip(pooled(p, tokens.at, rule) @ model.scale, -30, 30)))
                score[np.diff(tokens.at) == 0] = 0
            hit = np.flatnonzero(p >= 0.5)
            spans: list[list[int]] = [[] for _ in range(batch.num_rows)]
            if len(hit):
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before a byte
                of = np.searchsorted(tokens.at, hit, side="right") - 1
                for i, d in zip(hit.tolist(), of.tolist(), strict=True):
                    base = points[offsets[d]]
                    spans[d] += [int(points[tokens.starts[i]] - base), int(points[tokens.ends[i]] - base)]
            keep = [batch.column(j) for j in range(batch.num_columns) if j != at_text]
            names = [n for j, n in enumerate(batch.schema.names) if j != at_text]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(score), pa.array(spans, pa.list_(pa.int64()))], names=[*names, "score", "spans"])

    return run


def scored(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, rule: ToxicityRule = ToxicityRule()) -> DataFrame:
    """(doc_id, tkey, held_out, score, predicted, spans) for every row of docs.

    The field is fitted on labels and train_docs (docs itself if none).  A null or empty text has
    score 0 and no spans; a very long one is tagged whole.  Repeated rows keep a row each; a null doc_id is not held out.  Labels
    that are null or of unknown documents teach nothing; of several labels of one document the
    highest counts; a score of 0.5 is toxic.  An empty table gives no rows; other columns are ignored,
    whatever their names.  spans holds start,
    end, start, end ... of offending words in code points.
    """
    field = docs.sparkSession.sparkContext.broadcast(fitted(train_docs if train_docs is not None else docs, labels, rule))
    slim = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.col("text").cast("string").alias("text"))
    kind = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, tkey long, score double, spans array<long>"
    out = slim.mapInArrow(_score(field, rule, 2), kind)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(rule.folds))
    return out.select("doc_id", "tkey", F.coalesce(fold == rule.held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, rule: ToxicityRule = ToxicityRule()) -> DataFrame:
    """The rows of docs whose score is under 0.5; columns as they are, whatever their names.

    Null, empty and very long texts, ties, repeats and empty tables are as in ``scored``.
    """
    field = docs.sparkSession.sparkContext.broadcast(fitted(train_docs if train_docs is not None else docs, labels, rule))
    names, at_text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _score(field, rule, at_text)
        for batch in X.slices(batches):
            clean = [x < 0.5 for part in score(iter([batch])) for x in part.column(part.num_columns - 2).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.select(*names).mapInArrow(run, docs.schema)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, labels).select("doc_id", "held_out", "score", "predicted", "spans")
