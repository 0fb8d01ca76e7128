"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and, but for the last, returns the columns of documents. A stage's result is
written as Parquet in the shared folder and read again by the next, so a lost
executor costs no more than its part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liftlake.llm.common import documents, shared_folder
from liftlake.llm.packing import pack_documents
from liftlake.llm.quality_rules import keep_good
from liftlake.llm.queries import code_path
from liftlake.llm.source_mix import mix_documents
from liftlake.llm.suffix_dedup import remove_repeated_bytes
from liftlake.llm.trie_join import one_of_each_component


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    code_path(spark)
    return one_of_each_component(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes and more stay only where they occur first."""
    code_path(spark)
    return remove_repeated_bytes(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    code_path(spark)
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mixture),
    ("packing", packing),
]

# Packing works on token ids, which SQL cannot make; the tests hold the
# pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
