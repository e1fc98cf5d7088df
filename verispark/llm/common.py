"""Shared pieces: scratch tables in the shared folder, row keys and hash splits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, the warehouse, which executors share as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


class Scratch:
    """Tables that cut lineage: written once as Parquet, read back, dropped when no longer needed.

    A reread table has no lineage, so a lost executor repeats only the stage that was running.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/verispark/{name}-{uuid.uuid4().hex[:12]}"
        self.saved = 0
        self._delete_on_exit()

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete_on_exit(self) -> None:
        p, fs = self._hadoop(self.base)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def save(self, df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
        path = f"{self.base}/{self.saved}-{tag}"
        self.saved += 1
        writer = df.write.mode("errorifexists")
        if by:
            writer = writer.partitionBy(*by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "__dict__", {}).pop("_scratch_path", None)
            if path:
                p, fs = self._hadoop(path)
                fs.delete(p, True)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
