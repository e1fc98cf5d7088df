"""Benchmark decontamination by SimHash windows.

For each benchmark item, windows of the item's size slide over a document. A window's 64-bit fingerprint is looked up in a
multi-index: fingerprints are cut into radius + 1 blocks, and two that differ in at most radius bits agree in one block, so
no fingerprint within the radius is missed.  Candidates are verified by the exact weighted similarity of their shingles
(sum of the smaller counts over sum of the larger).

A document shorter than the item is one window as it is.  Only places that share a shingle with some item get windows;
anywhere else the similarity is zero.  The benchmark is used in
blocks of bounded size, each against all documents, so its size is no limit.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispark.llm.common import Scratch
from verispark.llm.workers import thrifty

SHINGLE = 5
LEAST = 0.8
RADIUS = 15
SEED = 42
#: Benchmark items in one broadcast block, and characters of each pass over the documents.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8_000_000


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingles_of(words: list[str], k: int = SHINGLE) -> list[str]:
    if len(words) < k:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def _bits(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)


_WEIGHTS = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


class Index:
    """Items by size, each size with its multi-index."""

    def __init__(self, items: list[tuple[int, str]], k: int, radius: int):
        self.k, self.radius = k, radius
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.grams = [Counter(shingles_of(w, k)) for _, w in self.items]
        self.by_word: dict[str, int] = {}
        self.gram_sizes: dict[str, set[int]] = defaultdict(set)
        prints = []
        for (_, w), g in zip(self.items, self.grams, strict=True):
            for x in w:
                self.by_word.setdefault(x, len(self.by_word) + 1)
            for s in g:
                self.gram_sizes[s].add(len(w))
            hs = shingles_of(w, k)
            prints.append((2 * _bits([xxhash.xxh64_intdigest(s, SEED) for s in hs]).sum(0) > len(hs)) @ _WEIGHTS)
        self.prints = np.array(prints, np.uint64)
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.sizes: dict[int, tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        for n in {len(w) for _, w in self.items}:
            own = np.array([i for i, (_, w) in enumerate(self.items) if len(w) == n])
            tables = []
            for shift, mask in self.blocks:
                v = (self.prints[own] >> shift) & mask
                order = np.argsort(v, kind="stable")
                tables.append((v[order], own[order]))
            self.sizes[n] = (own, tables)

    def within(self, prints: np.ndarray, size: int):
        """(window, item) pairs of this size within the radius."""
        pairs = []
        for (shift, mask), (values, own) in zip(self.blocks, self.sizes[size][1], strict=True):
            v = (prints >> shift) & mask
            a, b = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            n = b - a
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs.append(np.stack([np.repeat(np.arange(len(prints)), n), own[at]], 1))
        found = np.unique(np.concatenate(pairs), axis=0)
        if not len(found):
            return found
        near = np.bitwise_count(prints[found[:, 0]] ^ self.prints[found[:, 1]]) <= self.radius
        return found[near]

    def matches(self, text: str | None, least: float) -> list[tuple[int, int, int, float]]:
        """(item id, first word, words, similarity) of each item's best window of at least this similarity."""
        words = words_of(text)
        get = self.by_word.get
        known = np.fromiter((get(w, 0) for w in words), np.int32, len(words)) > 0
        if not known.any():
            return []
        k = self.k
        regions: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if len(words) >= k:
            run = np.convolve(known, np.ones(k, np.int32), "valid") == k
            for p in np.flatnonzero(run).tolist():
                for n in self.gram_sizes.get(" ".join(words[p : p + k]), ()):
                    regions[n].append((max(0, p - n + k), p))
        for n in self.sizes:  # items shorter than a shingle are one shingle of their own size
            if n < k:
                run = np.convolve(known, np.ones(n, np.int32), "valid") == n if len(words) >= n else np.zeros(0, bool)
                regions[n] += [(p, p) for p in np.flatnonzero(run).tolist() if " ".join(words[p : p + n]) in self.gram_sizes]
        best: dict[int, tuple[float, int]] = {}
        for n, spans in regions.items():
            if len(words) < n:  # the whole document is the one window
                if len(words) - k + 1 >= least * (n - k + 1) - 1e-9:
                    self._windows(words, n, 0, 0, least, best)
                continue
            spans.sort()
            merged: list[list[int]] = []
            for a, b in spans:
                b = min(b, len(words) - n)
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                elif a <= b:
                    merged.append([a, b])
            for a, b in merged:
                for c in range(a, b + 1, 4096):
                    self._windows(words, n, c, min(b, c + 4095), least, best)
        return [(self.items[i][0], at, min(len(self.items[i][1]), len(words)), s) for i, (s, at) in best.items()]

    def _windows(self, words, n, a, b, least, best) -> None:
        grams = shingles_of(words[a : b + n], self.k) if n >= self.k else [" ".join(words[i : i + n]) for i in range(a, b + 1)]
        each = max(1, min(n, len(words)) - self.k + 1)
        sums = np.zeros((len(grams) + 1, 64), np.int32)
        np.cumsum(_bits([xxhash.xxh64_intdigest(s, SEED) for s in grams]), axis=0, out=sums[1:])
        prints = (2 * (sums[each:] - sums[:-each]) > each) @ _WEIGHTS
        for w, i in self.within(prints, n).tolist():
            s = similarity(Counter(grams[w : w + each]), self.grams[i])
            if s >= least and (i not in best or (s, -(a + w)) > (best[i][0], -best[i][1])):
                best[i] = (s, a + w)


_INDEXES: dict[tuple, Index] = {}


def _index_of(key: str, shared, k: int, radius: int) -> Index:
    """The index of a block, made once in a Python worker; the last one is kept."""
    if (key, k, radius) not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key, k, radius] = Index(shared.value, k, radius)
    return _INDEXES[key, k, radius]


def _finder(key: str, shared, k: int, radius: int, least: float):
    def run(batches):
        index = _index_of(key, shared, k, radius)
        for b in batches:
            out = ([], [], [], [], [])
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for m in index.matches(t.as_py(), least):
                    for col, v in zip(out, (d, *m), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()], strict=True)], names=["id", "item_id", "first_word", "n_words", "similarity"])

    return run


def _without(at: int, key: str, shared, k: int, radius: int, least: float):
    """The rows whose text, the column number ``at``, holds no item."""

    def run(batches):
        index = _index_of(key, shared, k, radius)
        for b in batches:
            yield b.filter(pa.array([not index.matches(t.as_py(), least) for t in b.column(at)], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    block, chars = [], 0
    for r in benchmark.select(item_col, text_col).filter(F.col(text_col).isNotNull()).orderBy(item_col).toLocalIterator():
        block.append((r[0], r[1]))
        chars += len(r[1])
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", shingle: int = SHINGLE, radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """One row for each document and item it holds: id, item_id, first_word, n_words, similarity of the best window.

    Words are blank-separated and lower-cased.  Items without words never match; items of fewer words than a shingle are one
    shingle.  Null texts hold nothing; rows with a null id are searched like others, and each of repeated rows gives its rows.  Of windows of equal
    similarity the first counts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item_id long, first_word int, n_words int, similarity double"
    found = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, text_col):
        shared = spark.sparkContext.broadcast(block)  # BLOCK_CHARS and one item at most
        found = found.unionByName(scratch.save(src.mapInArrow(_finder(uuid.uuid4().hex, shared, shingle, radius, least), schema), "found"))
    return found.withColumnRenamed("id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", shingle: int = SHINGLE, radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns.  Each row is judged by its own text, so null and repeated ids make no difference."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "clean")
    for n, block in enumerate(_blocks(benchmark, item_col, text_col)):
        if n:
            docs = scratch.save(docs, "block")
        shared = spark.sparkContext.broadcast(block)  # BLOCK_CHARS and one item at most
        docs = docs.mapInArrow(thrifty(_without(docs.columns.index(text_col), uuid.uuid4().hex, shared, shingle, radius, least)), docs.schema)
    return docs
