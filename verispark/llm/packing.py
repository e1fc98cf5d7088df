"""Bulk-synchronous best-fit packing of tokenized documents into fixed-length sequences.

Pieces are sorted by length and open sequences by gap. A sweep takes the longest pieces, finds for them the successor
(the smallest gap that holds them), resolves conflicts by rank (the first pieces take the first sequences),
updates the gaps and repeats.  Lengths and gaps are whole numbers up to the sequence length, so both sorted
lists are held run-length encoded: a sweep matches whole runs.  The plan has at most 11 * 3 * 2,048 rows whatever the number of
documents: a length makes three runs at most, and each use of a run more than halves its gap.  The pieces themselves stay distributed: each gets its rank within its length from partial counts,
and an equi-join on the length with the plan gives its sequence and its place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verispark.llm.common import Scratch
from verispark.llm.memo_encoder import shared
from verispark.llm.token_files import _batches_of_texts
from verispark.llm.workers import thrifty

LENGTH = 2048
#: Characters of the texts that are encoded together: four times as many give the same ids in the same time and hold 60 MB more.
TOGETHER = 1 << 19
#: Pieces of one length that share a bucket when they are ranked.
RANKED_TOGETHER = 20_000


def sweep_plan(counts: dict[int, int], capacity: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Plan rows (length, first rank, end rank, first sequence, pieces a sequence, place of its first piece) and the number of sequences."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    plan, sequences = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            i = bisect_left(order, size)
            if i < len(order):
                gap = order[i]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(i)
            else:
                gap, first, n = capacity, sequences, -(-left // (capacity // size))
                sequences += n
            each = gap // size
            whole = min(n, left // each)
            if whole:
                plan.append((size, rank, rank + whole * each, first, each, capacity - gap))
                put(gap - each * size, first, whole)
                rank += whole * each
                left -= whole * each
            if whole < n and left:  # fewer than each are left: one sequence takes them
                plan.append((size, rank, rank + left, first + whole, left, capacity - gap))
                put(gap - left * size, first + whole, 1)
                whole, left = whole + 1, 0
            put(gap, first + whole, n - whole)
    return plan, sequences


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool, added: bool):
    def run(batches):
        enc = None
        for ids, texts in _batches_of_texts(batches, TOGETHER):
            enc = enc or shared(path, added)
            flat, counts = enc.encode(texts)
            out = ([], [], [], [], [], [])
            at = 0
            for d, n in zip(ids, counts.tolist(), strict=True):
                own = np.empty(n + 1, "<u4")
                own[:n] = flat[at : at + n]
                own[n] = end_id
                at += n
                for k, a in enumerate(range(0, n + 1, capacity)):
                    piece = own[a : a + capacity]
                    for col, v in zip(out, (d, k, a, len(piece), zlib.crc32(piece), piece.tobytes() if with_ids else None), strict=True):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types[:n], strict=True)], names=names[:n])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = LENGTH, with_ids: bool = False, added: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds the ids as little-endian uint32.
    added: as in ``MemoEncoder``.

    Null texts are empty and have the end id alone.  Only documents longer than ``capacity`` are cut.  Pieces
    of one length are ranked by id, piece and checksum, so repeated rows differ at most in which of them goes where.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    pieces = scratch.save(src.mapInArrow(thrifty(_pieces(tokenizer, end_id, capacity, with_ids, added)), schema), "pieces")
    lengths = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in lengths.collect()}  # at most one row for each length up to capacity
    plan, _ = sweep_plan(counts, capacity)

    buckets = max(1, -(-max(counts.values(), default=1) // RANKED_TOGETHER))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    before = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "bucket")
    table = spark.createDataFrame(plan, "length long, r0 long, r1 long, first long, each long, place long")
    met = ranked.join(F.broadcast(table), "length").filter("rank >= r0 and rank < r1")  # the plan is bounded by the lengths
    nth = F.col("rank") - F.col("r0")
    out = met.withColumn("sequence_id", F.expr("first + (rank - r0) div each")).withColumn("offset", F.col("place") + (nth % F.col("each")) * F.col("length"))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
