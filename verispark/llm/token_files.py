"""Token files: whole texts as ids, compressed by Re-Pair in shards, in ascending order of the document ids.

Documents are range-sorted by id before they are encoded, so ids never cross a shuffle.  Each task encodes its range
in turn and closes a shard at about ``shard_ids`` ids (a longer document has one of its own); memory is bounded by
one shard, one batch and one text.  A shard is one row of a Parquet table: range, number within the range, counts, bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verispark.llm.common import Scratch
from verispark.llm.memo_encoder import shared
from verispark.llm.repair import Shard, pack_shard

SCHEMA = "part int, shard int, n_docs long, n_ids long, doc_ids binary, none binary, data binary"
SHARD_IDS = 1 << 20
#: Characters of text of a range at most, on average: a larger table gets more ranges.
RANGE_CHARS = 1 << 27
BATCH_CHARS = 1 << 21


def _batches_of_texts(batches, most: int = BATCH_CHARS):
    """(ids, texts) of bounded size; null texts are empty."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _packer(path: str, end_id: int, first: int, shard_ids: int, added: bool):
    def close(part, shard, doc_ids, runs, sizes):
        data = pack_shard(np.concatenate(runs), np.cumsum(sizes), first)
        none = np.array([d is None for d in doc_ids])
        known = np.array([d or 0 for d in doc_ids], "<i8")
        cols = [[part], [shard], [len(sizes)], [int(sum(sizes))], [known.tobytes()], [np.packbits(none).tobytes()], [data]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=["part", "shard", "n_docs", "n_ids", "doc_ids", "none", "data"])

    def run(batches):
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        enc = None
        doc_ids, runs, sizes, held = [], [], [], 0
        for ids, texts in _batches_of_texts(batches):
            enc = enc or shared(path, added)
            flat, counts = enc.encode(texts)
            at = 0
            for d, n in zip(ids, counts.tolist(), strict=True):
                if doc_ids and held + n + 1 > shard_ids:
                    yield close(part, shard, doc_ids, runs, sizes)
                    shard += 1
                    doc_ids, runs, sizes, held = [], [], [], 0
                doc_ids.append(d)
                runs += [flat[at : at + n], np.array([end_id], np.int32)]
                sizes.append(n + 1)
                at += n
                held += n + 1
        if doc_ids:
            yield close(part, shard, doc_ids, runs, sizes)

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, shard_ids: int = SHARD_IDS, added: bool = False) -> None:
    """Writes every whole text, each followed by end_id.  Order: ascending id, null ids first; rows of the same id by a 64-bit hash of the text (in any order where that collides,
    which changes neither ids nor counts of a row).

    vocabulary: ids are below it.  added: as in ``MemoEncoder``.  Null texts are empty and have the end id alone; an empty table gives an empty file."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not parts:
        chars = src.agg(F.sum(F.length("text")).alias("n")).head()["n"] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS))
    tie = F.xxhash64("text")
    ranged = src.repartitionByRange(parts, F.col("id").asc(), tie).sortWithinPartitions(F.col("id").asc(), tie)
    ranged.mapInArrow(_packer(tokenizer, end_id, max(vocabulary, end_id + 1), shard_ids, added), SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(out)


def _digest(batches):
    for b in batches:
        for part, shard, ids, none, data in zip(*[b.column(i).to_pylist() for i in (0, 1, 4, 5, 6)], strict=True):
            s = Shard(data)
            every = np.frombuffer(ids, "<i8")
            gone = np.unpackbits(np.frombuffer(none, np.uint8))[: len(every)].astype(bool)
            flat = s.all_ids().astype("<u4")
            crcs = [zlib.crc32(flat[a:z]) for a, z in zip(s.id_at[:-1], s.id_at[1:], strict=True)]
            n = len(every)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(every, pa.int64(), mask=gone), pa.array(s.id_at[:-1]), pa.array(np.diff(s.id_at)), pa.array(crcs, pa.int64())],
                names=["part", "shard", "id", "at", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Decodes every shard: id, start (ids of all documents before), n_tokens, ids_crc32."""
    files = spark.read.schema(SCHEMA).parquet(path)
    # one row a shard, summed by range first, so the single window holds one row for each range
    ranges = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ranges = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_at"))
    shards = files.select("part", "shard", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("shard_at")).join(ranges, "part")
    rows = files.mapInArrow(_digest, "part int, shard int, id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shards, ["part", "shard"]).select(F.col("id").alias(id_col), (F.col("at") + F.col("shard_at") + F.col("part_at")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write_token_files(docs, f"{scratch.base}/files", tokenizer, end_id, vocabulary, id_col, text_col, added=added)
    return read_token_files(docs.sparkSession, f"{scratch.base}/files", id_col)
