"""A training-data pipeline over documents: clean, deduplicate, decontaminate and mix. Each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import decontaminate, lines, mixing, simhash, toxicity
from knotwork.llm.common import Cuts


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(spark, docs, sf_dir)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.keep_lines(spark, docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(spark, docs, sf_dir)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, whole, with size, source_size, target and taken: of a text the whole taken // size times, then its first taken % size words."""
    return mixing.keep_mixed(spark, docs)


STAGES = [("toxicity", clean), ("line_dedup", dedup_lines), ("simhash", dedup_documents), ("decontamination", decontaminated), ("mixing", mixed)]
#: Trained models, fingerprints and components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts, docs = Cuts(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cuts.table(stage(spark, docs, sf_dir), name)
    return docs
