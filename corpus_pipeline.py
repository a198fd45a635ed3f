"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes what its predecessor kept, whole, as a table with the columns of documents, and its
decisions take effect: rejected lines and documents, all but one of each group of near-duplicates,
contaminated documents and documents outside the mix are gone from the next stage on, and a document that
the mix repeats is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseweave.llm.decontaminate import clean_of
from caseweave.llm.mixing import mixed_documents
from caseweave.llm.quality import clean_documents
from caseweave.llm.sharding import shard, tree_of
from caseweave.llm.shared import materialize, table
from caseweave.llm.simhash import simhash_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines. Null texts are rejected."""
    return clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return simhash_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark windows cover less than a twentieth of the words."""
    return clean_of(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of the mix; empty where the mix is."""
    return shard(docs, tree_of(8)).withColumnRenamed("id", "doc_id").drop("grown_shard")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL has no XXH64 with a seed, which the near-duplicate stage rests on.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
