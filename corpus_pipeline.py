"""The corpus pipeline: language ID, MinHash near-dedup, substring dedup, mixing and packing, in that order.

Each stage's results for nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns are those of
its operator: texts without a letter go in the first stage, rows without a doc_id pass the second and third unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.op3_substrings import dedup_substrings
from skein.llm.op4_mixing import mix_sources
from skein.llm.op5_packing import digests, pack
from skein.llm.op7_language import identified
from skein.llm.op9_weighted_minhash import near_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go."""
    return identified(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more stay in their first document alone; n_chars follows the text."""
    cut = dedup_substrings(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their source's target weight draws them, shuffled."""
    return mix_sources(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens. The copies that mixing made are rows of their own; their pieces share doc_id and start, as stages hand on the columns of documents alone."""
    return digests(pack(docs))


STAGES = [("language", language), ("near_dedup", near), ("substring_dedup", substrings), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
