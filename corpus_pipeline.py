"""Corpus pipeline: each stage works on what the stage before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger.llm import language_id, mixing, near_dedup, packing, substring_dedup
from salesledger.llm.columns import fresh
from salesledger.llm.staging import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BATCH = 500
"""Documents that a Python worker gets at once; Spark's default of 10,000 is meant for short rows."""


def _short_batches(stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, which replaces ``lang``; those without a letter go.

    All other columns keep their values, whatever their names. Where no document has both a language and letters, nothing can be recognised: ``lang`` stays as it is.
    """
    profiles = language_id.fit(docs)
    lang, score = fresh("lang", docs.columns), fresh("score", docs.columns)
    # Any profile tells the texts with a letter from those without.
    known = language_id.predict(docs, profiles or {"any": [0]}, names=(lang, score))
    known = known.where(F.col(lang) != language_id.UNKNOWN)
    return (known.withColumn("lang", F.col(lang)) if profiles else known).select(*docs.columns)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.drop_near_duplicates(docs)


def _substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents left without a word go."""
    return substring_dedup.drop_repeated_passages(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix(docs, mixing.label_weights(labels))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", _short_batches(_language)),
    ("near_dedup", _short_batches(_near_dedup)),
    ("substring_dedup", _short_batches(_substring_dedup)),
    ("mixing", _short_batches(_mixing)),
    ("packing", _short_batches(_packing)),
]

ORACLE_SQL = None
"""N-gram ranks, chains and packing have no whole-table SQL; the tests compare run() with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
