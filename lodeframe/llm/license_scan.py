"""License scans: word sets of text blocks that hold a license template, by an exact set-similarity join.

A block is a window of ``slack`` times as many words as a template has.  It meets the template if it
holds at least ``threshold`` of the template's distinct words.  The words of all templates are ordered
by their frequency in the whole corpus, rarest first, and windows are tried only where

* prefix: one of the template's few rarest words stands in them, as without all of these too few are left;
* length: they hold as many words of the template as must be met;
* position: the words from the rarest one found onwards, in template and in window, are enough.

Words that no template has can't add to what a block holds of one, so they have no place in the order.
Templates are a list of the caller's and go to every task; documents stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as X
from .scratch import free

# Phrases with their labels, and the opening or telling sentences of public licenses.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD, SLACK = 0.9, 2


def words_of(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = X.words(data, np.array([0, len(data)]), X.ALNUM)
    low = X.ALNUM[1][data]
    return [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


@dataclass
class Vocabulary:
    """The words of all templates and phrases."""

    known: list[bytes]

    @cached_property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes, the word of each)."""
        data = np.frombuffer(b"".join(self.known), np.uint8)
        ends = np.cumsum([len(w) for w in self.known])
        hashes = X.word_hashes(data, np.r_[0, ends[:-1]], ends)
        order = np.argsort(hashes)
        return hashes[order], order

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text; text, place and known word of each hit, by text and place); hits are compared byte by byte."""
        data, offsets = X.column_bytes(texts)
        n_words = np.zeros(len(texts), np.int64)
        hits = []
        hashes, of = self.keys
        for part, offs, owner in X.stretches(data, offsets, X.ALNUM[0]):
            starts, ends, at = X.words(part, offs, X.ALNUM)
            low = X.ALNUM[1][part]
            own = X.word_hashes(low, starts, ends)
            where = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            index = np.flatnonzero(hashes[where] == own)
            word = of[where[index]]
            same = np.zeros(len(index), bool)
            for w in np.unique(word):
                text, these = self.known[w], np.flatnonzero(word == w)
                a = starts[index[these]]
                fits = ends[index[these]] - a == len(text)
                these, a = these[fits], a[fits]
                same[these] = (low[a[:, None] + np.arange(len(text))] == np.frombuffer(text, np.uint8)).all(1)
            index, word = index[same], word[same]
            text = np.searchsorted(at, index, side="right") - 1
            hits.append((text + owner, index - at[text] + n_words[text + owner], word))
            n_words[owner : owner + len(at) - 1] += np.diff(at)
        return n_words, *(np.concatenate(c) if hits else np.zeros(0, np.int64) for c in (zip(*hits, strict=True) if hits else ((), (), ())))


@dataclass
class Template:
    """A template: the ranks of its distinct words, rarest first."""

    label: str
    rank: np.ndarray  # by known word; -1: not in the template
    size: int
    need: int
    window: int

    def blocks(self, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, last place, words held) of each window that meets the template and starts with one of its words.

        Places are of all texts of a batch, set apart by more than a window.
        """
        rank = self.rank[word]
        own = np.flatnonzero(rank >= 0)
        place, rank = place[own], rank[own]
        prefix = self.size - self.need + 1
        if not (rank < prefix).any():
            none = np.zeros(0, np.int64)
            return none, none, none
        end = np.searchsorted(place, place + self.window)
        start = np.flatnonzero(end - np.arange(len(place)) >= self.need)  # length
        end = end[start]
        holds = lambda r: (lambda c: c[end] > c[start])(np.r_[0, np.cumsum(rank == r)])
        rarest = np.full(len(start), self.size)
        for r in reversed(range(prefix)):
            rarest[holds(r)] = r
        tried = np.minimum(self.size - rarest, end - start) >= self.need  # prefix and position
        start, end = start[tried], end[tried]
        held = np.zeros(len(start), np.int64)
        for r in range(self.size):
            held += holds(r)
        met = held >= self.need
        return place[start[met]], place[end[met] - 1], held[met]


def vocabulary(templates, phrases) -> Vocabulary:
    return Vocabulary(sorted({w for _, t in templates for w in words_of(t)} | {w for p, _ in phrases for w in words_of(p)}))


def frequencies(docs: DataFrame, known: Vocabulary) -> np.ndarray:
    """How often each known word occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(known.known), np.int64)
        for batch in X.slices(batches):
            counts += np.bincount(known.found(batch.column(0))[3], minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts)), pa.int64()), pa.array(counts, pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a known word
    counts = np.zeros(len(known.known), np.int64)
    for r in rows:
        counts[r.word] = r.n
    return counts


def ordered(templates, known: Vocabulary, counts: np.ndarray, threshold: float, slack: int) -> list[Template]:
    """Templates with their words in the corpus's order: rarest first, ties by bytes."""
    place = {w: i for i, w in enumerate(known.known)}
    out = []
    for label, text in templates:
        words = words_of(text)
        own = sorted({place[w] for w in words}, key=lambda i: (counts[i], i))
        if own:
            rank = np.full(len(place), -1)
            rank[own] = np.arange(len(own))
            out.append(Template(label, rank, len(own), max(1, math.ceil(round(threshold * len(own), 9))), slack * len(words)))
    return out


def merged(first: np.ndarray, last: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Windows that overlap as one: (first place, last place, most words held)."""
    i = 0
    while i < len(first):
        j, end = i + 1, last[i]
        while j < len(first) and first[j] <= end:
            end = max(end, last[j])
            j += 1
        yield int(first[i]), int(end), int(held[i:j].max())
        i = j


KINDS = ("long", "array<struct<label string, first_word long>>", "array<struct<label string, first_word long, last_word long, containment double>>", "double")


def scanned(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, slack: int = SLACK) -> DataFrame:
    """docs with four columns more: n_words, places, blocks and score.

    places: (label, first_word) wherever a phrase's words stand one behind the other; blocks: (label,
    first_word, last_word, containment) for each stretch of windows that meet a template, overlapping
    windows as one.  score: 1 with a phrase, else the greatest containment of a block, else 0.  Words
    count from 0.  A null, empty or word-less text has no places and no blocks; very long texts are
    scanned whole; repeated rows are scanned each; ties of frequency fall to the smaller word, which
    changes no result; an empty table gives no rows.  Where docs has a column of one of these names,
    the new one gets an underscore behind.
    """
    known = vocabulary(templates, phrases)
    place = {w: i for i, w in enumerate(known.known)}
    lines = [(label, [place[w] for w in words_of(p)]) for p, label in phrases]
    tried = ordered(templates, known, frequencies(docs, known), threshold, slack)
    apart = max([t.window for t in tried] + [len(w) for _, w in lines]) + 1
    names = free(docs.columns, "n_words", "places", "blocks", "score")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at_text = docs.columns.index("text")
    places_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
    blocks_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            n_words, text, at, word = known.found(batch.column(at_text))
            base = np.r_[0, np.cumsum(n_words + apart)][:-1]
            at = at + base[text]
            places, blocks = [[] for _ in n_words], [[] for _ in n_words]
            for label, line in lines:
                first = at[word == line[0]]
                for i, w in enumerate(line[1:], 1):
                    first = first[np.isin(first + i, at[word == w])]
                for p, t in zip(first.tolist(), (np.searchsorted(base, first, side="right") - 1).tolist(), strict=True):
                    places[t].append({"label": label, "first_word": p - int(base[t])})
            for template in tried:
                for a, b, held in merged(*template.blocks(at, word)):
                    t = int(np.searchsorted(base, a, side="right")) - 1
                    blocks[t].append({"label": template.label, "first_word": a - int(base[t]), "last_word": b - int(base[t]), "containment": held / template.size})
            score = [1.0 if p else max((x["containment"] for x in b), default=0.0) for p, b in zip(places, blocks, strict=True)]
            new = [pa.array(n_words, pa.int64()), pa.array(places, places_type), pa.array(blocks, blocks_type), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    new = T.StructType.fromDDL(", ".join(f"{n} {kind}" for n, kind in zip(names, KINDS, strict=True)))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new.fields]))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.col("places.first_word")
    return scanned(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "blocks.label")).alias("labels"),
        "score",
    )
