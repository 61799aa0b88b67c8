"""A corpus pipeline: quality filter, exact and near deduplication, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages but the last return the columns of ``docs``.
``run`` writes each stage's rows as Parquet to the shared folder and reads them again for the next one; what the stage's
operators have staged on the way is deleted then.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, quality
from barflow.sources.stage import scope, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows of the input table."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the one with the smallest id."""
    return jaccard_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without spans of benchmark items, and without documents hit in over half of their words."""
    clean = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(clean.schema["n_chars"].dataType), "n_chars"))
    return clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the bytes decoded from them."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality classifier", good_quality), ("exact dedup", without_copies), ("n-gram Jaccard join", without_near_copies),
          ("benchmark decontamination", without_benchmark), ("byte-level BPE", tokens)]
#: The classifier's decisions have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"), outlast=True)
    return STAGES[-1][1](spark, docs, sf_dir)
