"""Corpus pipeline: toxic documents go, one document of each near-duplicate
group stays, repeated passages are cut, contaminated documents go, and what is
left is mixed to the sources' target weights.

Every stage takes (spark, docs, sf_dir) and works on all rows of its
predecessor; its result is written as Parquet and read again. All stages but
the last return the columns of documents, whatever else ``docs`` has; an empty
table passes through every stage.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import op1_mixing, op3_wu_manber, op4_parity, op5_toxicity, op6_suffix
from .common import keep, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among
    ``docs``, does not reject. A NULL or empty text has the model's bias as its
    score and stays unless that rejects; repeated rows share their fate; a NULL
    doc_id has no label; without rows of both labels nothing but what that one
    label says is decided (no toxic row: all stay)."""
    model = op5_toxicity.learn(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return op5_toxicity.without_toxic(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles, similarity 0.8:
    the one with the smallest doc_id (of several texts under it, the smallest
    hash; of repeated rows, one). NULL and empty texts are linked with nothing
    and all stay, as do rows without a doc_id."""
    return op4_parity.one_per_group(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 200-byte strings that occur twice. No row is
    dropped; NULL stays NULL; a text that is repeated whole, as repeated rows
    are, becomes empty if it has 200 bytes or more; ``n_chars`` is the new
    length where a text changed."""
    return op6_suffix.without_repeats(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate. NULL and empty texts
    have no words and stay; repeated rows share their fate; an empty benchmark
    rejects nothing."""
    return op3_wu_manber.without_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark", "item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as it is taken, with ``size``,
    ``target``, ``copies`` and ``copy`` (from 1). NULL and empty texts have size
    0 and one copy; a NULL source is one of its own, the last; rows with equal
    doc_id and text take equal copies."""
    return op1_mixing.mixed(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
]

#: A learnt score cannot be said in SQL; the stages have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
