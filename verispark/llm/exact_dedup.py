"""Exact de-duplication by deterministic block naming.

A text is cut into blocks of ``block_bytes`` bytes.  The distinct blocks are sorted and numbered; then
adjacent names are paired and the distinct pairs sorted and numbered again, until each document
has one name.  Two documents have the same (number of blocks, name) exactly if their texts are equal:
every name stands for one sorted content, so no hash decides equality.

Copies of a block collapse in the map-side combine before they are sorted, so a hot block costs one row per
task.  Names go back to the rows by the block's SHA-256, after a check on the distinct blocks that no two share
one; if two ever do, the names go back by the blocks themselves.  All tables in those joins are
plain scratch tables, so Spark can split a skewed one.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.llm.common import Scratch, fresh, is_empty

BLANKS = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _named(distinct: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number distinct rows: (partition, rank in the sorted partition) as one integer."""
    return distinct.sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256 and the identity (n_blocks, name).

    Of rows with equal texts the one with the smallest id stays; among repeated rows of the same id
    just one.  Null ids come after all others.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    src = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).select(F.monotonically_increasing_id().alias("rid"), "id", "norm")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / F.lit(block_bytes))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.substring(F.col("bin"), i * block_bytes + 1, F.lit(block_bytes)))
    cut_src = src.withColumn("nb", n_blocks).withColumn("bin", F.col("norm").cast("binary"))
    handle = F.unhex(F.sha2("block", 256))

    rows = scratch.save(
        cut_src.withColumn("sha", F.sha2("bin", 256)).select("rid", "id", "sha", "nb", F.posexplode(cut).alias("pos", "block")).select("rid", "id", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "nb", "pos", handle.alias("handle")),
        "rows",
    )
    blocks = cut_src.select(F.explode(cut).alias("block")).groupBy("block").agg(F.lit(0).alias("one"))
    names = scratch.save(_named(blocks.select("block"), ["block"], "name").select(handle.alias("handle"), "name"), "names")
    if is_empty(names.groupBy("handle").count().filter("count > 1")):
        cur = scratch.save(rows.select("rid", "nb", "pos", "handle").join(names, "handle").select("rid", "nb", "pos", "name"), "level")
    else:  # two blocks share a digest: join on the blocks themselves
        by_block = cut_src.select("rid", "nb", F.posexplode(cut).alias("pos", "block"))
        scratch.drop(names)
        names = scratch.save(_named(blocks.select("block"), ["block"], "name"), "names")
        cur = scratch.save(by_block.join(names, "block").select("rid", "nb", "pos", "name"), "level")
    scratch.drop(names)

    ident = cur.filter("nb = 1").select("rid", "nb", "name")
    left = 1
    while True:
        left *= 2
        more = cur.filter(F.col("nb") > left // 2)
        if is_empty(more):
            break
        pairs = scratch.save(
            more.groupBy("rid", "nb", F.floor(F.col("pos") / 2).cast("int").alias("half")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")),
            "pairs",
        )
        names = scratch.save(_named(pairs.select("a", "b").distinct(), ["a", "b"], "name"), "names")
        cur = scratch.save(pairs.join(names, ["a", "b"]).select("rid", "nb", F.col("half").alias("pos"), "name"), "level")
        scratch.drop(pairs, names)
        ident = ident.unionByName(cur.filter(F.col("nb") <= left).select("rid", "nb", "name"))
    docs_ = rows.filter("pos = 0").select("rid", "id", "sha")
    full = scratch.save(docs_.join(ident, "rid"), "ident")
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    groups = scratch.save(full.groupBy("nb", "name").agg(F.min(key).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    return full.join(groups, ["nb", "name"]).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("nb").alias("n_blocks"), "name"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns.

    The block names decide.  Where ids are unique, rows that go are found again by their id; where some repeat, rows that stay are found
    by id and digest, and of rows that agree in both one stays."""
    found = exact_groups(docs, id_col, text_col)
    name, sha = fresh(docs, "found"), fresh(docs, "found_sha")
    if is_empty(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")):
        gone = found.filter("not kept").select(F.col(id_col).alias(name))
        return docs.join(gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
    own = fresh(docs, "own_sha")
    kept = found.filter("kept").select(F.col(id_col).alias(name), F.col("text_sha256").alias(sha))
    out = docs.withColumn(own, F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).join(kept, F.col(id_col).eqNullSafe(F.col(name)) & (F.col(own) == F.col(sha)), "left_semi")
    return out.dropDuplicates([id_col, own]).drop(own)
