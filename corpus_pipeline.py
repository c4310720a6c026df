"""The corpus pipeline: each stage works on what its predecessor kept and returns documents.

A stage is a function (spark, docs, sf_dir) -> DataFrame. Columns of documents
pass through, whatever they are called; columns that begin with two
underscores are for the stages' own use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from ledgerlens.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = quality_rules.rated(docs, table(spark, sf_dir, "labels"), docs.columns)
    return rows.where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest doc_id."""
    return near_dedup.first_of_class(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    docs = mixing.with_copies(docs)
    rows = mixing.with_taken(docs, mixing.cuts(spark, docs)).where("__times > 0")
    return rows.select(*own, F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))).alias("__copy")).select(*own)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.shard(docs).drop("depth", "n_bytes", "shard_bytes", "shard_docs", "oversize")


STAGES = [
    ("quality rules", quality_stage), ("near-dedup", near_dedup_stage), ("decontamination", decontamination_stage),
    ("mixing", mixing_stage), ("sharding", sharding_stage),
]

#: Risk-controlled cutoffs, verified near-duplicates and hash splits are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
