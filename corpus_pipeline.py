"""A corpus pipeline: toxic texts, near copies, personal data, the source mix and packing.

Every stage works on what its predecessor kept. `run` writes each stage's documents to the
shared folder in spark.checkpoint.dir before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.common import stage
from tablewright.llm.mixing import mixed_documents
from tablewright.llm.ngram_join import keep_one
from tablewright.llm.packing import pack
from tablewright.llm.personal_data import masked_documents
from tablewright.llm.toxicity import clean_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the classifier learns from ``labels`` that aren't held out."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id."""
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return masked_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return pack(docs)


STAGES = (
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_copies),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("packing", packing),
)
# Classifiers, components and token ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
