"""Corpus pipeline over documents: language, exact and near copies, benchmark passages, packing.

Each stage works on every row its predecessor kept and returns the columns of documents, the last
one the packed pieces. run() writes and rereads each stage's rows in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plexmatch.llm.common import store, table
from plexmatch.llm.decontaminate import decontaminated
from plexmatch.llm.exact_dedup import exact_deduplicated
from plexmatch.llm.language_id import accepted_documents
from plexmatch.llm.minhash import near_deduplicated
from plexmatch.llm.packing import packed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is one of the learned ones."""
    return accepted_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest doc_id."""
    return exact_deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the smallest doc_id."""
    return near_deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, with sequence and offset."""
    return packed(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("packing", packing)]

ORACLE_SQL = None  # languages and tokens are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
