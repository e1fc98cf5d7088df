"""A training-corpus pipeline over ``documents``: language, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last keep the columns of
documents.  ``run`` writes each result as Parquet to the shared scratch folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispark.llm import decontaminate, exact_dedup, language_gru, packing, simhash
from verispark.llm.common import Scratch
from verispark.llm.queries import WORD_END, WORD_FILE, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those to which the network gives no language with a probability of 0.5."""
    return language_gru.drop_rejected(docs, language_gru.fit(docs, F.lit(True)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays.  Links of SimHash fingerprints, and then what a prefix filter adds, are confirmed on five-word shingles at a similarity of 0.8."""
    return simhash.one_of_each(docs, simhash.verified_duplicates(docs))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left is cut into pieces and packed."""
    return packing.pack(docs, tokenizer_path(WORD_FILE), WORD_END, added=True)


STAGES = [("language", language), ("exact copies", exact_copies), ("near copies", near_copies), ("benchmark leaks", leaks), ("packing", pack)]

#: SQL expresses neither the network nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        scratch.drop(docs)
        docs = done
    return docs
