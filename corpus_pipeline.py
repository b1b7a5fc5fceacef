"""Corpus pipeline: quality, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. SQL cannot express the fitted machine or the sampling, so there is no oracle: the stages are tested
against brute force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isopleth.llm import stages
from isopleth.plans.session import drop, scratch

STAGES = [
    ("quality classifier", stages.quality),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("PII surrogates", stages.private),
    ("mixing to target weights", stages.mix),
    ("BPE encoding", stages.encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; what a stage returns is kept in the shared folder until the next is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{number}")
        docs = spark.read.parquet(f"{top}/{number}")
        if number:
            drop(spark, f"{top}/{number - 1}")
    return docs
