"""From raw documents to packed sequences in five stages.

Each stage reads the Parquet that the one before it wrote, works on all of it, and returns documents with the
same columns; the last returns the places of the pieces. A stage trains or counts on its own input alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from galley.llm import exact_dedup, language, packing, pii, simhash
from galley.llm.common import discard, documents, scratch, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter, or like no language at all, go."""
    return language.drop_unknown(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the longest original."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more over shingles of five words)."""
    return simhash.drop_near(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by the kind of data."""
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("pii", private), ("packing", pack)]

#: SQL can't express the stages that learn and the packing; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the pieces of what all stages keep. Tables that a stage made on its way go when its result is
    written, and that result when the next stage has read it; those of the last stage stay for the caller to read from."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
