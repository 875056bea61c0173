"""From raw documents to packed training sequences: five stages, each over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import written
from quillon.llm.jaccard import keep_one_of_each
from quillon.llm.language import keep_identified
from quillon.llm.mixing import mixed_documents
from quillon.llm.packing import pack_documents
from quillon.llm.secrets import redact_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null texts, texts without letters or of unknown n-grams.

    Repeated rows stay or go alike; other columns, whatever their names, stay as they are; an
    empty table gives an empty one. That holds for the next stages too, but for what they say.
    """
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join stays: five words, similarity 0.8 or more.

    A row that repeats the one that stays goes. Documents without words stay, each of them.
    """
    return keep_one_of_each(docs, num=80, den=100, width=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; every document stays."""
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated, or left out, as the mix of the sources takes it; rows that repeat count each."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences with their ids: each copy of a document is packed by itself."""
    return pack_documents(docs, keep_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: Learned filters, set joins and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
