"""Chunk sources: one function for each kind, all giving id, text, vector, metadata, ingested_at.

A limit of None reads everything; a limit of 0 reads nothing, whatever the source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispark.schemas import CHUNK

COLUMNS = ["id", "text", "vector", "metadata", "ingested_at"]


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def from_memory(spark: SparkSession, documents: Iterable[dict[str, Any]], limit: int | None = None) -> DataFrame:
    """Rows in their order; missing fields are null, a missing id is the position."""
    rows = [tuple(str(d.get("id", i)) if c == "id" else d.get(c) for c in COLUMNS) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows if limit is None else rows[:limit], CHUNK)


def from_texts(spark: SparkSession, texts: list[str], vectors: list[list[float]] | None = None, metadatas: list[dict] | None = None, prefix: str = "doc") -> DataFrame:
    """ids prefix-0, prefix-1, ...; lists that are too short leave nulls."""
    at = lambda xs, i: xs[i] if xs is not None and i < len(xs) else None
    return from_memory(spark, [{"id": f"{prefix}-{i}", "text": t, "vector": at(vectors, i), "metadata": at(metadatas, i)} for i, t in enumerate(texts)])


def from_json(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A JSON array of chunks, or one chunk a line."""
    df = spark.read.schema(CHUNK).json(path, multiLine=True)
    missing = F.concat(F.lit(""), F.monotonically_increasing_id().cast("string"))
    return _limited(df.withColumn("id", F.coalesce("id", missing)), limit)


def from_parquet(spark: SparkSession, path: str, id_col: str = "id", text_col: str = "text", vector_col: str | None = "vector", limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    vector = F.col(vector_col).cast("array<float>") if vector_col and vector_col in df.columns else F.lit(None).cast("array<float>")
    rest = {"metadata": "map<string,string>", "ingested_at": "string"}
    return _limited(df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), vector.alias("vector"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in rest.items()]), limit)


def quoted(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def from_jdbc(
    spark: SparkSession, url: str, table: str, id_column: str = "id", text_column: str = "text", vector_column: str = "embedding", metadata_column: str | None = None, time_column: str | None = None,
    limit: int | None = None, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str,
) -> DataFrame:
    """A table with vectors as text such as [1,2,3].  Five columns are read, identifiers are quoted, the limit is in the query; with a partition column the read is split."""
    extra = [quoted(metadata_column) + "::text AS metadata" if metadata_column else "NULL AS metadata", quoted(time_column) + "::text AS ingested_at" if time_column else "NULL AS ingested_at"]
    split = f", {quoted(partition_column)} AS part_key" if partition_column else ""
    name = ".".join(quoted(p) for p in table.split("."))
    query = f"SELECT {quoted(id_column)}::text AS id, {quoted(text_column)} AS text, {quoted(vector_column)}::text AS vector, {', '.join(extra)}{split} FROM {name}"
    query += f" LIMIT {int(limit)}" if limit is not None else ""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) AS chunks", **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn="part_key", lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return parsed(reader.load().drop("part_key"))


def parsed(df: DataFrame) -> DataFrame:
    """Vectors and metadata from their texts."""
    return df.select(F.col("id").cast("string").alias("id"), "text", F.from_json(F.col("vector").cast("string"), "array<float>").alias("vector"), F.from_json(F.col("metadata").cast("string"), "map<string,string>").alias("metadata"), F.col("ingested_at").cast("string").alias("ingested_at"))


SOURCES: dict[str, Callable[..., DataFrame]] = {"memory": from_memory, "texts": from_texts, "json": from_json, "parquet": from_parquet, "pgvector": from_jdbc}


def get_source(kind: str, spark: SparkSession, **config: Any) -> DataFrame:
    """The source of a kind; paged stores (chroma, pinecone, milvus) are read by ``verispark.sources.paged``."""
    from verispark.sources.paged import STORES, from_store

    if kind in SOURCES:
        return SOURCES[kind](spark, **config)
    if kind in STORES:
        return from_store(spark, kind, **config)
    raise ValueError(f"unknown source {kind!r}; known: {', '.join(sorted([*SOURCES, *STORES]))}")


def count(chunks: DataFrame) -> int:
    return chunks.count()
