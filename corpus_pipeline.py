"""Preparation of training text: `documents` to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from echotide.llm import exact_dedup, langid, mixing, near_dedup, packing
from echotide.llm.common import documents, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts of no clear language."""
    return langid.known_language(docs, langid.train(docs.where(~langid.held_out())))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the largest doc_id, of those with equal texts."""
    return exact_dedup.one_of_each(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest doc_id, of each group of near duplicates."""
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each text by the words that the mix takes of it; documents that it takes nothing of go."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Hashed features, sketches and tokenisation are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
