"""The corpus pipeline: five stages over ``documents``, each on all the one before kept.

Language identification drops documents without a known language, one document
of each group of near-duplicates (SimHash search, then exact similarity 0.8 of
five-word shingles, which also finds what the search's radius misses) is kept,
decontamination drops documents that hold a benchmark item, the secret scan masks
what it finds, and packing lays the rest out in training sequences.  Stages are
written as Parquet below the cluster's shared folder and read again, so a lost
executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matloom.llm.decontaminate import without_leaks
from matloom.llm.language_id import reject_unknown
from matloom.llm.packing import pack
from matloom.llm.secret_scan import mask_secrets
from matloom.llm.simhash import keep_one
from matloom.runtime import Workspace

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_unknown(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    ws = Workspace(spark, file_factor=1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), path=ws.new_path(name)).df
    return docs
