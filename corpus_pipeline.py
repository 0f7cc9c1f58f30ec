"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, encoding."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from martingrid.llm import bpe, catalog, mixing, pii, quality, simhash
from martingrid.llm.common import shared_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path(catalog.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii_pseudonyms", pseudonymise),
    ("mix_sources", mix),
    ("byte_bpe", encode),
]
#: SQL can express neither the mix nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{home}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
