"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickforge.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from tickforge.llm.common import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similar ones connect, the one with the least doc_id."""
    return ngram_join.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of rarer sources again as far as the target weights ask."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram jaccard join", near), ("source mixing", mixed), ("best-fit packing", packed)]

#: SQL has no byte-pair encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that run() wrote, wherever it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage hands on lies in the checkpoint folder until the next has been written; the last such table stays, as the result reads it."""
    prepare(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}")
        docs = spark.read.parquet(f"{shared}/{k}")
        if k:
            _remove(spark, f"{shared}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
