"""Corpus preparation in five stages: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result
is written as Parquet and read again as the next one's docs.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import decontamination, ngram_join, packing, substring_dedup, toxicity
from lodeframe.llm.scratch import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field, fitted on the labelled documents, does not reject.

    A null, empty or word-less text stays; a very long one is scored whole; a score of 0.5 rejects;
    repeated rows share their fate; without labels all stay; an empty table gives no rows.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 Jaccard over 5-word shingles join.

    Null, empty and very long texts, ties, repeated rows, empty tables and clashing columns are as in
    ``one_of_each``.
    """
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences of repeated spans; n_chars follows the text.

    A document all of whose sentences occur elsewhere before keeps its row, with an empty text; a
    null or empty text stays.  Repeated rows, ties, very long texts, an empty table and columns that
    clash with the operator's are as in ``without_repeats``.
    """
    cut = substring_dedup.without_repeats(docs, substring_dedup.WHOLE)
    if "n_chars" in docs.columns:
        removed = cut.columns[-1]
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no 10-word window of the benchmark occurs.

    A null or empty text stays; a very long one is scanned whole; repeated rows share their fate;
    an empty benchmark rejects none; an empty table gives no rows.
    """
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words: a row for each piece of each document.

    Null, empty and very long texts, ties, repeated rows, empty tables and clashing columns are as in
    ``packed``; exact copies, should any be left, go to different bins.
    """
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Model scores and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; gives the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
