"""Slices of batches, and what a task leaves in its worker."""

import random
import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verispark.llm import decontaminate, language_gru, packing, simhash, workers
from verispark.llm.queries import WORD_END, WORD_FILE, tokenizer_path


def batch(ids, texts):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])


def test_slices_hold_the_same_rows():
    whole = [batch([1, None, 3], ["a" * 50, None, "ü"]), batch([], []), batch(range(1000), ["x" * 100] * 1000), batch([7], ["y" * 10_000])]
    for most in (1, 500, 1 << 30):
        got = list(workers.sliced(whole, most))
        assert [r for b in got for r in b.to_pylist()] == [r for b in whole for r in b.to_pylist()]
        assert all(b.num_rows == 1 or b.nbytes <= 2 * most for b in got)
    assert len(list(workers.sliced(whole, 1 << 30))) == 3


def test_slices_change_no_result(monkeypatch):
    whole = [batch(range(40), [None if i % 9 == 0 else "some words of one text " * (i % 7) for i in range(40)])]
    for run in (simhash._sets(5), packing._pieces(tokenizer_path(WORD_FILE), WORD_END, 8, False, True)):
        monkeypatch.setattr(workers.sliced, "__defaults__", (100,))
        assert [r for b in workers.thrifty(run)(whole) for r in b.to_pylist()] == [r for b in run(whole) for r in b.to_pylist()]


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_a_task_leaves_little_behind():
    def held():
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    rng = random.Random(3)
    texts = [" ".join(str(rng.getrandbits(20)) for _ in range(400)) for _ in range(5000)]
    one = batch(range(len(texts)), texts)
    del texts
    workers.give_back()
    before = held()
    assert sum(b.num_rows for b in workers.thrifty(simhash._sets(5))([one])) == 5000
    assert held() - before < 25  # 60 MB and more without


def test_the_pipeline_s_tasks_give_memory_back(spark, monkeypatch):
    asked, given = [], []
    frame = type(spark.range(0))
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: asked.append(f) or real(self, f, *a, **b))
    docs = spark.createDataFrame([(i, f"text number {i // 2} has words of its own and some more") for i in range(8)], "doc_id long, text string")
    language_gru.drop_rejected(docs, ({}, [], language_gru.HIDDEN))
    decontaminate.drop_leaks(docs, spark.createDataFrame([(1, "an item of the benchmark with words")], "item_id long, text string"))
    packing.pack(docs, tokenizer_path(WORD_FILE), WORD_END)
    assert len(asked) == 3
    assert simhash.verified_duplicates(docs).filter(F.col("doc_id") != F.col("component_id")).count() == 4
    monkeypatch.setattr(workers, "give_back", lambda: given.append(1))
    own = [f for f in asked if "_edges_of" not in f.__qualname__]
    for f in own:
        list(f(iter([])))
    assert len(own) > 9 and len(given) == len(own)
