"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link at ``RADIUS`` or fewer differing bits.  Each bit position gets a non-zero vector of
RADIUS + 1 bits; mask v keeps the positions whose vector has an odd product with v.  Fewer than RADIUS + 1
vectors never span the space, so for every pair within the radius some mask v != 0 drops all the differing positions:
the pair meets in that table, with certainty.

Equal fingerprints are one class from the start, so copies cost nothing.  Buckets are counted with partial aggregates;
only those of two or more classes go on.  A bucket beyond ``CELL`` classes is dealt into cells, one for each pair
of blocks, so no task holds more than two blocks and every pair of the bucket still meets.  A cell gives
a spanning forest of its links, never all pairs.

``near_duplicates`` links by fingerprints of shingles alone.  ``verified_duplicates`` takes the links of the fingerprints as candidates and
confirms them by the exact similarity of the texts' five-word shingles; similar pairs whose fingerprints are further apart than the radius
are then found by a prefix filter over the groups that are left, which misses none.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispark.llm.common import Scratch, fresh
from verispark.llm.components import connected_components
from verispark.llm.memo_encoder import release
from verispark.llm.workers import thrifty

RADIUS = 3
CELL = 8192
SEED = 42
#: Words of a shingle of a fingerprint.
WORDS = 3
#: For the exact links: one of so many texts is sampled for common shingles, of which so many at most are ordered last; buckets beyond
#: CROWD texts are first joined by stars, in so many rounds, and dealt in blocks of BLOCK.
SAMPLED, COMMON = 32, 100_000
CROWD, ROUNDS, BLOCK = 64, 3, 1024
#: Places in which the parity of a set's shingles is kept; a power of two.  More places tell more sets apart before they are compared.
PLACES = 512
#: Bits of a sieve of ids; a power of two.  Rows that it lets pass without need cost time alone.
SIEVE = 1 << 24
#: Rows of a task at most, on average: classes that become fifteen rows, members of 24 bytes.
A_TASK = 2_000_000


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Signed 64-bit masks, 2 ** (radius + 1) - 1 of them."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(64)]
    masks = [sum(1 << i for i, phi in enumerate(vectors) if (phi & v).bit_count() % 2) for v in range(1, top)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _shingles(text: bytes, k: int) -> list[bytes]:
    words = text.lower().split()
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*[words[i:] for i in range(k)], strict=False)]


def _hashes(items: list[bytes], seed: int = SEED) -> np.ndarray:
    """XXH64 of each."""
    return np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=seed), items)), ">u8").astype(np.uint64)


def _ones(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run of hashes how often each of the 64 bits, highest first, is set.

    Every eighth bit is summed at once, in groups of 255 hashes so that no sum leaves its byte."""
    out = np.zeros((len(lengths), 64), np.int64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    n = lengths[full]
    groups = -(-n // 255)
    first_group = np.cumsum(groups) - groups
    start = np.repeat(np.cumsum(n) - n, groups) + 255 * (np.arange(groups.sum()) - np.repeat(first_group, groups))
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), start)
        by_byte = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8), first_group, axis=0, dtype=np.int64)
        out[full[:, None], 63 - k - 8 * np.arange(8)[None, :]] = by_byte
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    return (bits * (np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def _majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64 majority bits as one integer; empty runs give 0."""
    return _packed(2 * _ones(hashes, lengths) > lengths[:, None])


def _fingerprints(k: int, seeds: tuple[int, ...]):
    names = [f"fp{i}" for i in range(len(seeds))]

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
                cols = [b.column(0)]
                for seed in seeds:
                    runs = [_hashes(_shingles(x, k), seed) for x in texts]
                    cols.append(pa.array(_majority(np.concatenate(runs), np.array([len(r) for r in runs])).view(np.int64)))
                yield pa.RecordBatch.from_arrays(cols, names=["id", *names])

    return run, names


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """id and one 64-bit fingerprint a seed (fp0, fp1, ...) for every row; null texts are empty and have the fingerprint zero.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; a text of fewer words than a shingle is one shingle."""
    run, names = _fingerprints(shingle, seeds)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def _linked(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> None:
    """Joins labels along the pairs (a, b).  Every label is the smallest member's, before and after; only such roots are hooked, and every pair
    is looked at again until all have equal ends."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def _forest(fps: np.ndarray, runs: np.ndarray, radius: int, first: np.ndarray | None = None) -> np.ndarray:
    """Label of each member (the index of a member it reaches), links being within runs of equal run number.

    ``first``, if given, holds the members' own indices and gets that of the first member that each links to, if one comes before it."""
    n = len(fps)
    labels = np.arange(n)
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= 64, sizes)
    a_all, b_all = [], []
    for d in range(1, int(sizes[sizes <= 64].max(initial=1))):
        i = np.flatnonzero((runs[:-d] == runs[d:]) & small[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
        a_all.append(i)
        b_all.append(i + d)
        if first is not None:
            first[i + d] = i  # a larger d finds an earlier one
    if a_all:
        _linked(np.concatenate(a_all), np.concatenate(b_all), labels)
    for s, m in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        own = fps[s : s + m]
        for r in range(0, m, 128):
            a, b = np.nonzero(np.bitwise_count(own[r : r + 128, None] ^ own[None, :]) <= radius)
            _linked(a + s + r, b + s, labels)
            if first is not None:
                np.minimum.at(first, b + s, a + s + r)
    return labels


def _edges_of(radius: int, direct: bool = False):
    """Rows sorted by cell become edges; the rows of a cell may span batches."""

    def emit(cell, fps, reps):
        first = np.arange(len(fps))
        j = _forest(fps, cell, radius, first if direct else None)
        i = np.flatnonzero(j != np.arange(len(j)))
        k = np.flatnonzero((first != j) & (first != np.arange(len(j))))
        i, j = np.r_[i, k], np.r_[j[i], first[k]]
        return pa.RecordBatch.from_arrays([pa.array(reps[i]), pa.array(reps[j])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)].cumsum() if batch.num_rows else None
            key = tuple(c[0] for c in cols[:4])
            last = tuple(c[-1] for c in cols[:4])
            fps, reps = cols[4].view(np.uint64), cols[5]
            if held:
                if held[0] == key:
                    new = np.r_[np.full(len(held[1]), 1), new]
                else:
                    new = np.r_[np.zeros(len(held[1]), np.int64), new]
                fps, reps = np.r_[held[1], fps], np.r_[held[2], reps]
            cut = int(np.searchsorted(new, new[-1], "left"))
            if cut:
                yield emit(new[:cut], fps[:cut], reps[:cut])
            held = (last, fps[cut:], reps[cut:])
        if held:
            yield emit(np.zeros(len(held[1]), np.int64), held[1], held[2])

    return run


def link_fingerprints(classes: DataFrame, scratch: Scratch, radius: int = RADIUS, cell: int = CELL, direct: bool = False) -> DataFrame:
    """classes: fam int, fp long, rep long.  Edges (a, b) between reps whose fingerprints of a family link: a spanning forest of each cell.

    The forest joins members to the smallest one they reach; ``direct`` adds a link of each member to the first one it links to itself."""
    tables = F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(covering_masks(radius))])
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() // A_TASK))
    spread = classes.repartition(parts, "fam", "fp")  # a small table otherwise comes in a few tasks, and each row becomes fifteen
    rows = spread.select("fam", "fp", "rep", F.inline(tables)).withColumn("tab", F.col("tab") + F.col("fam") * 1000)
    crowded = scratch.save(rows.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    met = rows.join(crowded, ["tab", "key"])
    blocks = F.ceil(F.col("n") / cell).cast("int")
    one = met.filter(F.col("n") <= cell).select("tab", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "rep")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    many = met.filter(F.col("n") > cell).withColumn("own", own).select("tab", "key", "own", "fp", "rep", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    many = many.select("tab", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rep")
    dealt = one.unionByName(many) if not crowded.filter(F.col("n") > cell).limit(1).count() == 0 else one
    keys = ["tab", "key", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_edges_of(radius, direct), "a long, b long")


def _groups(fps: DataFrame, names: list[str], scratch: Scratch, radius: int) -> DataFrame:
    """fps with component_id."""
    classes = scratch.save(fps.groupBy(*names).agg(F.min("id").alias("rep")).filter("rep is not null"), "classes")
    families = [classes.groupBy(F.lit(i).alias("fam"), F.col(n).alias("fp")).agg(F.min("rep").alias("rep")) for i, n in enumerate(names)]
    by_fam = families[0]
    for f in families[1:]:
        by_fam = by_fam.unionByName(f)
    by_fam = scratch.save(by_fam, "families") if len(names) > 1 else by_fam
    edges = link_fingerprints(by_fam, scratch, radius)
    if len(names) > 1:  # classes that share the fingerprint of one family
        for i, n in enumerate(names):
            same = classes.join(by_fam.filter(F.col("fam") == i).select(F.col("fp").alias(n), F.col("rep").alias("low")), n)
            edges = edges.unionByName(same.filter("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    edges = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    parts = connected_components(edges, scratch)
    labelled = scratch.save(classes.join(parts, classes["rep"] == parts["node"], "left").select(*names, F.coalesce("component", "rep").alias("component_id")), "labels")
    return fps.join(labelled, names, "left").select("id", *names, "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, seeds: tuple[int, ...] = (SEED,), radius: int = RADIUS) -> DataFrame:
    """One row for each input row: id, the fingerprints fp0, fp1, ... and component_id, the smallest id reachable over links.

    Two rows link if the fingerprints of any one seed differ in ``radius`` or fewer bits.  Rows whose id is null take part and
    keep a null component unless they link to others.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(simhash(docs, id_col, text_col, shingle, seeds), "fingerprints")
    return _groups(fps, [c for c in fps.columns if c != "id"], scratch, radius).withColumnRenamed("id", id_col)


def _slot():
    return F.pmod(F.xxhash64("id"), F.lit(SIEVE)).alias("slot")


def _sieve(ids: DataFrame) -> np.ndarray:
    """SIEVE bits, of which those of the ids are set: of fixed size, whatever the input."""
    words = ids.select(_slot()).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(SIEVE // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def _in_sieve(sieve: np.ndarray, slots) -> pa.Array:
    slots = slots.to_numpy(zero_copy_only=False)
    return pa.array((sieve[slots >> 6] >> (slots & 63) & 1).astype(bool))


def _sifted(shared, passes: bool = True):
    """Rows whose id, by the slot in their last column, may be one of the sieve's; with ``passes`` false those whose id is none of them."""

    def run(batches):
        for b in batches:
            keep = _in_sieve(shared.value, b.columns[-1])
            yield b.filter(keep if passes else pc.invert(keep)).select(b.schema.names[:-1])

    return run


def _sets(k: int):
    """Sorted distinct 64-bit hashes of each text's k-word shingles."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                rows.append(np.unique(_hashes(_shingles(t or b"", k))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["id", "set"])

    return run


def _similar(least: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    return run


def _likely(least: float):
    """Pairs whose first shingles leave room for the similarity.

    Similar sets share c shingles at least, so each misses few of the other's; of the prefix that ends first in the common order, all
    shared ones are in the other prefix as well."""

    def run(batches):
        for b in batches:
            keep = []
            for n, m, x, y in zip(*[c.to_pylist() for c in b.columns[2:]], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                c = least / (1 + least) * (n + m) - 1e-6
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= c + min(len(x) - n, len(y) - m))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    return run


def _common_shingles(src: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that a sample of the texts has more than once, ascending, and their ranks from 1, the most common last.

    They only order the shingles: any order gives the same links, this one keeps buckets small."""

    def run(batches):
        for b in _sets(k)(batches):
            sets = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], names=["h"])

    sample = src.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).mapInArrow(thrifty(run), "h long")
    got = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h = np.array([r["h"] for r in got], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.arange(len(h), 0, -1)[order]


def _prefixes(k: int, least: float, shared):
    """id, fingerprint, digest of the set of shingles in two halves, its size, its first shingles in the common order, and the parity of its shingles in PLACES places.

    Of two sets at ``least`` or more, each has one of the other's among so many first ones."""

    def run(batches):
        release()
        h, rank = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                digests, sizes, firsts, parities = [], [], [], []
                texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
                runs = [_hashes(_shingles(x, WORDS)) for x in texts]
                prints = _majority(np.concatenate(runs), np.array([len(r) for r in runs])).view(np.int64)
                for t in texts:
                    s = np.unique(_hashes(_shingles(t, k)))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    parities.append(np.packbits((np.bincount((s & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES) & 1).astype(np.uint8)).tobytes())
                    if len(h):
                        place = np.minimum(np.searchsorted(h, s), len(h) - 1)
                        s = s[np.argsort(np.where(h[place] == s, rank[place], 0), kind="stable")]
                    firsts.append(s[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1].tobytes())
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                halves = [pa.array(d[:, k].copy()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints), *halves, pa.array(sizes, pa.int32()), pa.array(firsts, pa.binary()), pa.array(parities, pa.binary())], names=["id", "fp", "d0", "d1", "n", "first", "parity"])

    return run


_MEMBER = np.dtype([("h", "<u8"), ("id", "<i8"), ("at", "<i4"), ("n", "<i4")])


def _packed_members(m: np.ndarray) -> bytes:
    """All first bytes of the members, then all second ones and so on, which compress well."""
    return m.view(np.uint8).reshape(-1, _MEMBER.itemsize).T.tobytes()


def _members(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(_MEMBER.itemsize, -1).T).view(_MEMBER).reshape(-1)


def _dealt(parts: int, shared, common: bool):
    """Every first shingle as a member (hash, id, its place, size of the set): those of common shingles as rows, the others packed by the part of the hash.

    A group of any size may share a common shingle, and so the rows of one never meet in one task."""

    def run(batches):
        h = shared.value[0]
        for b in batches:
            firsts = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            lengths = np.array([len(x) for x in firsts], np.int64)
            m = np.empty(int(lengths.sum()), _MEMBER)
            if not len(m):
                continue
            m["h"] = np.concatenate(firsts)
            m["id"] = np.repeat(b.column(0).to_numpy(), lengths)
            m["n"] = np.repeat(b.column(1).to_numpy(), lengths)
            m["at"] = np.arange(len(m)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            if len(h):
                m = m[(h[np.minimum(np.searchsorted(h, m["h"]), len(h) - 1)] == m["h"]) == common]
            if common:
                yield from _rows_of(m)
                continue
            if not len(m):
                continue
            part = (m["h"] % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            m, part = m[order], part[order]
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array([_packed_members(x) for x in np.split(m, cut[1:])], pa.binary())], names=["part", "members"])

    return run


def _rows_of(m: np.ndarray):
    for a in range(0, len(m), 1 << 16):
        x = m[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x["h"].astype(np.int64)), *[pa.array(x[c].copy()) for c in ("id", "at", "n")]], names=["h", "id", "at", "n"])


def _met(batches):
    """Members whose shingle is another's as well.  A shingle that is not among the common ones has few members."""
    packed = [_members(x) for b in batches for x in b.column(1).to_pylist()]
    m = np.concatenate([np.empty(0, _MEMBER), *packed])
    del packed
    m = m[np.argsort(m["h"], kind="stable")]
    same = m["h"][1:] == m["h"][:-1]
    yield from _rows_of(m[np.r_[False, same] | np.r_[same, False]] if len(m) else m)


def _candidates(least: float):
    """Rows sorted by cell (h, i, j) become the pairs of block i with block j whose labels differ and whose sets can still be similar.

    A shingle that one set alone has turns one place of the parities, so they differ in no more places than the sets do in shingles; sets at
    ``least`` differ in a share (1 - least) / (1 + least) of both sizes at most.  So no similar pair is left out."""

    def emit(c, x, y):
        _, _, _, own, ids, at, n, label, parity = c
        apart = (label[x] != label[y]) & (own[x] == c[1][x]) & (own[y] == c[2][x]) & ((c[1][x] != c[2][x]) | (ids[x] < ids[y]))
        x, y = x[apart], y[apart]
        left = np.minimum(n[x] - at[x], n[y] - at[y])  # if no earlier shingle is shared, as many can be at most
        x, y = (v[left * (1 + least) >= least * (n[x] + n[y]) - 1e-6] for v in (x, y))
        turned = sum(np.bitwise_count(p[x] ^ p[y]).astype(np.int64) for p in parity.T)
        x, y = (v[turned * (1 + least) <= (1 - least) * (n[x].astype(np.int64) + n[y]) + 1e-6] for v in (x, y))
        return np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y])

    def pairs(c):
        new = np.r_[True, np.any([k[1:] != k[:-1] for k in c[:3]], axis=0)]
        start = np.flatnonzero(new)
        sizes = np.diff(np.r_[start, len(new)])
        run = np.cumsum(new)
        small = np.repeat(sizes <= CROWD, sizes)
        for d in range(1, int(sizes[sizes <= CROWD].max(initial=1))):
            x = np.flatnonzero((run[:-d] == run[d:]) & small[:-d])
            if not len(x):
                break
            yield emit(c, np.r_[x, x + d], np.r_[x + d, x])
        for s, m in zip(start[sizes > CROWD], sizes[sizes > CROWD], strict=True):
            for r in range(s, s + m, 128):
                x = np.arange(r, min(r + 128, s + m))
                yield emit(c, np.repeat(x, m), np.tile(np.arange(s, s + m), len(x)))

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [col.to_numpy(zero_copy_only=False) for col in batch.columns[:-1]]
            c.append(np.frombuffer(b"".join(batch.columns[-1].to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            c = [np.r_[x, y] for x, y in zip(held, c, strict=True)] if held else c
            cut = int(np.flatnonzero(np.any([k != k[-1] for k in c[:3]], axis=0)).max(initial=-1)) + 1
            held = [x[cut:] for x in c]
            if cut:
                for a, b in pairs([x[:cut] for x in c]):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if held:
            for a, b in pairs(held):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def verified_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """id and component_id.  Two rows link if the sets of ``shingle``-word shingles of their texts have a Jaccard similarity of ``least`` or more.

    Equal sets are one class.  Fingerprints within RADIUS, found in covering tables as in ``near_duplicates``, are candidates, and
    those confirmed join classes first.  Two sets so similar share one of their first shingles in any common order, so classes that share one
    and are still apart are the other candidates.  Those of crowded buckets are joined by confirmed stars first; then every candidate pair that
    is left is confirmed.  Nulls and empty tables as in ``near_duplicates``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "verified")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(_common_shingles(src, shingle))  # COMMON at most
    every = scratch.save(src.mapInArrow(thrifty(_prefixes(shingle, least, shared)), "id long, fp long, d0 long, d1 long, n int, first binary, parity binary"), "prefixes")
    classes = scratch.save(every.groupBy("d0", "d1").agg(F.min("id").alias("id")).filter("id is not null"), "classes")

    def sifted(rows: DataFrame, sieve, passes: bool = True) -> DataFrame:
        return rows.select("*", _slot()).mapInArrow(thrifty(_sifted(sieve, passes)), rows.schema)

    prints = every.select("id", "d0", "d1")
    named = classes.select("d0", "d1", F.col("id").alias("low"))
    copies = prints.join(named, ["d0", "d1"], "left").filter("id is null or low is null or id != low").select("id")
    some = spark.sparkContext.broadcast(_sieve(copies))
    fields = every.select("id", "fp", "d0", "d1", "n", "first", "parity")
    kept = scratch.save(sifted(fields, some).join(classes, ["id", "d0", "d1"], "left_semi").select("id", "fp", "n", "first", "parity"), "firsts")
    one = sifted(fields.drop("d0", "d1"), some, False).unionByName(kept)

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs.distinct(), "pairs")
        sieve = spark.sparkContext.broadcast(_sieve(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))))
        some = scratch.save(sifted(one.select("id", "n", "first"), sieve), "ends")
        firsts = lambda i, n, x: some.select(F.col("id").alias(i), F.col("n").alias(n), F.col("first").alias(x))
        both = pairs.join(firsts("a", "n", "x"), "a").join(firsts("b", "m", "y"), "b")
        likely = scratch.save(both.select("a", "b", "n", "m", "x", "y").mapInArrow(thrifty(_likely(least)), "a long, b long").distinct(), "likely")
        scratch.drop(pairs, some)
        sieve = spark.sparkContext.broadcast(_sieve(likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id")))))
        sets = scratch.save(sifted(src, sieve).mapInArrow(thrifty(_sets(shingle)), "id long, set binary"), "sets")
        both = likely.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        out = scratch.save(both.select("a", "b", "x", "y").mapInArrow(thrifty(_similar(least)), "a long, b long"), "confirmed")
        scratch.drop(likely, sets)
        return out

    by_print = scratch.save(one.groupBy("fp").agg(F.min("id").alias("rep")).select(F.lit(0).alias("fam"), "fp", "rep"), "families")
    equal = one.select("id", "fp").join(by_print, "fp").filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    near = link_fingerprints(by_print, scratch, direct=True).unionByName(equal)
    links = confirm(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    scratch.drop(by_print)

    members = one.agg(F.sum(F.length("first"))).head()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-members // (8 * A_TASK)))
    firsts = one.select("id", "n", "first")
    met = firsts.mapInArrow(thrifty(_dealt(4 * parts, shared, False), slices=False), "part int, members binary").repartition(parts, "part").mapInArrow(thrifty(_met, slices=False), "h long, id long, at int, n int")
    if shared.value[0].size:
        met = met.unionByName(firsts.mapInArrow(thrifty(_dealt(4 * parts, shared, True), slices=False), "h long, id long, at int, n int"))
    met = scratch.save(met, "members")

    def labelled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of the buckets that hold more than one component, with the size of the bucket, and the links as stars.

        A member stays if the bucket has sets of a size that can be similar to its own, with as many shingles left from this one on."""
        nodes = connected_components(links, scratch)
        rows = met.join(nodes.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        rows = scratch.save(rows, "labelled")
        left = F.col("n") - F.col("at")
        sizes = [F.min("n").alias("fewest"), F.max("n").alias("most"), F.sum("n").alias("total"), F.min(left).alias("left")]
        mixed = rows.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), *sizes).filter("low < high")
        two = (F.col("size") > 2) | (F.col("left") * (1 + least) >= F.col("total") * least - 1e-6)
        mixed = mixed.filter(two).select("h", "size", "fewest", "most")
        fits = (F.col("most") >= F.col("n") * least - 1e-6) & (left * (1 + least) >= (F.col("n") + F.greatest("fewest", F.col("n") * least)) * least - 1e-6)
        out = scratch.save(rows.join(mixed, "h").filter(fits).select(*rows.columns, "size"), "mixed")
        scratch.drop(rows)
        return out, nodes.select(F.col("node").alias("a"), F.col("component").alias("b"))

    rows, links = labelled(links)
    for r in range(ROUNDS):
        crowded = rows.filter(F.col("size") > crowd)
        if crowded.limit(1).count() == 0:
            break
        hubs = crowded.groupBy("h").agg(F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("k"), "id", "label")).alias("hub"))
        star = crowded.join(hubs, "h").filter("label != hub.label").select(F.greatest("id", "hub.id").alias("a"), F.least("id", "hub.id").alias("b"))
        found = confirm(star)
        scratch.drop(rows)
        rows, links = labelled(links.unionByName(found))
        if found.limit(1).count() == 0:
            break
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = rows.join(one.select("id", "parity"), "id").withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keys = ["h", "i", "j"]
    dealt = dealt.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "at", "n", "label", "parity")
    found = confirm(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(thrifty(_candidates(least), slices=False), "a long, b long"))
    nodes = connected_components(links.unionByName(found), scratch)
    named = scratch.save(classes.join(nodes, classes["id"] == nodes["node"], "left").select("d0", "d1", F.coalesce("component", "id").alias("component_id")), "labels")
    return prints.join(named, ["d0", "d1"], "left").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is the smallest of their group, with all their columns; rows with a null id stay.  Rows that repeat an id go or stay together."""
    gone = fresh(docs, "gone")
    ids = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone))
    return docs.join(ids, F.col(id_col) == F.col(gone), "left_anti")
