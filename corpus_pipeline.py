"""Corpus preparation in five stages, each a function (spark, docs, sf_dir) over all that its predecessor kept.

1. quality: documents that the classifier rejects go.
2. near_duplicates: one document of each SimHash component stays.
3. decontamination: documents that hold a benchmark item go.
4. mixing: documents are taken as often as the mix of sources takes them; one document of a source is cut.
5. sharding: every row gets its shard and its slot in the shard.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import decontaminate, mixing, quality, sharding, simhash
from attestor.llm.common import shared_root, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier, the fingerprints' components and the latent space are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Each result is written as Parquet in the shared checkpoint folder and read
    again as the next stage's input, so a lost executor never costs more than a stage."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{root}/{k}-{name}")
            docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
