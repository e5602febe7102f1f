"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing. Each stage works on all its predecessor kept.

The first three return the columns of documents, whatever they are called; the last returns the packed places. `run` applies
them to documents, each written as Parquet in the shared folder and read again.

Defined results: null and empty texts have no toxic words and pass the first stage, and fail the second (fewer than 20
words). Rows that repeat a doc_id with a text of their own are judged each by itself; of rows that share a doc_id only one
stays behind the third stage if they are alike, and rows without a doc_id all stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import common, jaccard_join, length_buckets, quality, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not predict as toxic."""
    common.ship(spark)
    return toxicity.mild(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    common.ship(spark)
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles: the one with the smallest doc_id."""
    common.ship(spark)
    return jaccard_join.representatives(docs, k=5, num=80, den=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document left."""
    return length_buckets.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("packing", pack),
]

#: SQL can express neither learned scores nor binomial cutoffs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
