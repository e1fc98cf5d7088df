"""Connected components over an edge table by alternating large-star and small-star rounds.

Every round is two equi-joins on plain scratch tables with partial aggregates before each shuffle, so a hub's edges
can be split by Spark; labels never reach the driver.  Tables of few edges are written to few files, as each file costs an executor
several child processes where Hadoop's native library is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispark.llm.common import Scratch


#: Files of a table, and edges of a file on average beyond FILES * A_FILE edges.
FILES, A_FILE = 16, 200_000


def _star(edges: DataFrame, scratch: Scratch, large: bool, files: int) -> DataFrame:
    """Edges (u, v) with u > v; joins each neighbourhood to its smallest member."""
    near = edges.select("u", "v")
    if large:
        near = near.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = scratch.save(near.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")).coalesce(files), "lows")
    met = near.join(lows, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("low").alias("v")).union(lows.select("u", F.col("low").alias("v")))
    return scratch.save(out.filter("u > v").distinct().coalesce(files), "edges")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: two long columns a, b.  Returns node, component (the smallest node reachable) for nodes that have edges."""
    cur = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    state, n = None, cur.count()
    while True:
        files = max(FILES, -(-n // A_FILE))
        big = _star(cur, scratch, True, files)
        small = _star(big, scratch, False, files)
        scratch.drop(big, cur)
        cur = small
        mark = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(mark) == state or not mark[0]:
            break
        state, n = tuple(mark), mark[0]
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
