"""The training-corpus pipeline: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes the documents that the one before kept and returns them with the columns of documents; the last one
returns packed sequences. The classifiers learn from the labels of the documents that reach them.

Nulls, empty texts, repeated rows, empty tables and further columns are as the operators' modules say. In the
near-duplicate stage one row of each component stays: the one with the component's id, and of several rows with that id
the one with the least hash of its columns; where a component has no id (all are null) the row with the least hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.llm import packing, quality, simhash_near, suffix_dedup, toxicity
from lexigauge.llm.common import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep(docs, toxicity.train(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose five-word shingles are alike by about 0.8 or more, by sampled SimHash segments: see the operator's module."""
    return simhash_near.keep_one(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts change, so the count of their characters does too."""
    kept = suffix_dedup.keep(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", passage_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifiers nor the suffix sorting; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
