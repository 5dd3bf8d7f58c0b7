"""A corpus from raw documents to token ids: each stage reads what the one before has written.

Stages: quality rules by line frequency (rejected documents go, lines above the limits leave the text), quality classifier
(documents below the threshold go), n-gram Jaccard join (one document of each group stays), benchmark
decontamination (contaminated documents go), byte-level BPE (the result: ids and digests per document).
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from pricetide.llm import byte_bpe, factorisation, jaccard_join, line_frequency, spaced_seeds
from pricetide.session import SESSION_CONF, ensure_checkpoint_dir

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(stage):
    """The stage with Arrow batches bounded by their bytes: by rows alone, the texts of a whole partition are one batch, held by the JVM and by Python."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(_BATCH_BYTES, SESSION_CONF[_BATCH_BYTES])
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_frequency.filter_documents(docs)


@small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return factorisation.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spaced_seeds.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The classifier, the spaced seeds and BPE have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
