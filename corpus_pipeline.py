"""From raw documents to training shards, one operator of ``corrobora.llm`` a stage.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept,
and its decisions take effect: all but the last return the columns of documents.
Between stages the rows are written as Parquet and read again, so a lost executor
never costs more than the stage it worked on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corrobora.llm import decontaminate, mixing, near_dup, quality, sharding
from corrobora.llm.storage import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects go."""
    return quality.good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dup.first_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target; a document is returned once per copy taken."""
    return mixing.mixed_documents(docs)


def final_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix with its shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [("quality classifier", quality_classifier), ("MinHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("source mixing", source_mixing), ("sharding", final_sharding)]

#: The first stages learn and hash in ways that SQL cannot express; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
