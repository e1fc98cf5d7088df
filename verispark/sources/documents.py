"""Readers of system specifications, reports and the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispark.schemas import SYSTEM

#: Versions of wire documents that are understood.
KNOWN_SCHEMAS = ["verispark.report/v1", "verispark.dossier/v1", "verispark.evidence/v1"]


def system_specs(spark: SparkSession, path: str) -> DataFrame:
    """Unknown keys are ignored."""
    return spark.read.schema(SYSTEM).json(path, multiLine=True)


def report(spark: SparkSession, path: str) -> DataFrame:
    """One row (schema, raw JSON); a document of an unknown version is refused."""
    raw = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.schema").alias("schema"), F.col("value").alias("raw"))
    odd = [r["schema"] for r in raw.filter(~F.coalesce(F.col("schema").isin(KNOWN_SCHEMAS), F.lit(False))).limit(1).collect()]
    if odd:
        raise ValueError(f"unknown schema {odd[0]!r}")
    return raw


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Deals rows over the cores where the input has fewer parts than cores, as a small file of one row group has; any larger input stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *by) if rows.rdd.getNumPartitions() < cores else rows


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the embedding of the same number, where there is one."""
    docs, vecs = spread(table(spark, sf_dir, "documents"), "doc_id"), table(spark, sf_dir, "embeddings")
    return docs.join(vecs.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left").select(F.col("doc_id").alias("id"), "text", "vector")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings of even numbers as the baseline, of odd numbers as the current state."""
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vecs.filter("id % 2 = 0"), vecs.filter("id % 2 = 1")
