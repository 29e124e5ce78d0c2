"""Corpus pipeline: from all documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; its result is
written and read again before the next. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.minhash_dedup import near_dedup
from tidemark.llm.packing import default_tokenizer, pack, pieces
from tidemark.llm.quality_classifier import classify, fit, graded
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.session import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the ordinal classifier, fitted on the ratings of this corpus, finds good and clean."""
    model = fit(docs, graded(table(spark, sf_dir, "labels")))
    return classify(docs, model).where("kept").select(docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass every rule of the cascade."""
    return quality_rules(docs).where("kept").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest number of each group linked by five-word shingles."""
    return near_dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words of 20-word windows that occur earlier; untouched texts stay as they are.

    `n_chars` follows the text. A document that loses every word stays, with an empty text.
    """
    found = substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = found.withColumn("text", text)
    return changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its sequence and its place there."""
    return pack(pieces(docs, default_tokenizer()))


STAGES = [
    ("quality_classifier", quality),
    ("quality_rules", rules),
    ("minhash_near_dedup", near_copies),
    ("substring_dedup", passages),
    ("best_fit_packing", sequences),
]

#: No SQL: the classifier is fitted. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
