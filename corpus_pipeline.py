"""Corpus preparation as a chain of stages over ``documents``; see the functions for what each one decides.

All stages but the last return the columns of ``documents``. Models are fitted on the stage's own input.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from staleguard.llm import neardup, packing, pii, quality, toxicity
from staleguard.llm.queries import BYTE_BPE, END_ID, toxicity_model
from staleguard.llm.shared import written
from staleguard.session import checkpoint_dir, clean_up
from staleguard.sources.tables import load


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or that the model finds of low quality go."""
    return quality.keep_good(docs, quality.fit_quality(docs, load(spark, sf_dir, "labels", "doc_id", "quality")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.keep_ordinary(docs, toxicity_model(spark, docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share four fifths of their five-word shingles the document with the least id stays."""
    return neardup.keep_one(docs, "doc_id", "text", k=5, num=4, den=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind; n_chars follows."""
    return pii.mask_personal_data(docs, pii.fit_field(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 1024 tokens: one row per piece."""
    return packing.pack_documents(docs, "doc_id", "text", BYTE_BPE, END_ID)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near-duplicates", near_dedup),
    ("personal data", personal_data),
    ("best-fit packing", pack_sequences),
]

#: The stages can't be written as SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written in the shared folder and read again by the next.

    The driver lets go of a stage's plans before the next one begins.
    """
    checkpoint_dir(spark)
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
            clean_up(spark)
    return docs
