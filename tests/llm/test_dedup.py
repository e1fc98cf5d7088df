import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from verispark.llm import exact_dedup, simhash


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_groups(rows):
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    return {i: (min(by[norm(t)]), len(by[norm(t)])) for i, t in rows}


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_exact_groups_against_brute_force(spark, block):
    rng = random.Random(block)
    pool = ["", " ", "a", "a b", "a\t\n b", "é" * 10, "x" * 100, "x" * 99 + "y", "ab" * 40, "ab" * 40 + "a", "y" + "x" * 99]
    rows = [(i, rng.choice([*pool, None])) for i in range(120)]
    got = exact_dedup.exact_groups(docs(spark, rows), block_bytes=block).collect()
    want = brute_groups(rows)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert all(r["text_sha256"] == hashlib.sha256(norm(dict(rows)[r["doc_id"]]).encode()).hexdigest() for r in got)


def test_long_texts_that_differ_in_one_place(spark):
    a = "word " * 20_000
    rows = [(1, a), (2, a), (3, a[:50_000] + "X" + a[50_001:]), (4, a + "."), (5, "." + a)]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_shared_digest_falls_back_to_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "is_empty", lambda df: False if "handle" in df.columns else df.limit(1).count() == 0)
    rows = [(1, "a" * 10), (2, "a" * 10), (3, "b" * 10)]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs(spark, rows), block_bytes=4).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_nulls_repeated_rows_extra_columns_and_empty_tables(spark):
    rows = [(7, "t", "x"), (7, "t", "x"), (None, "t", "y"), (3, None, "z"), (4, "", None)]
    d = docs(spark, rows, "doc_id long, text string, name string")
    got = exact_dedup.exact_groups(d).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got) == 2
    kept = exact_dedup.drop_copies(d).collect()
    assert sorted((r["doc_id"], r["name"]) for r in kept) == [(3, "z"), (7, "x")] and kept[0].asDict().keys() == {"doc_id", "text", "name"}
    assert exact_dedup.exact_groups(d.limit(0)).count() == 0


def brute_print(t, k=3, seed=42):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, seed) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, prints, radius=3):
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                low[b] = a
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(0, 200))] for _ in range(30)]
    rows = []
    for b in base:
        for _ in range(4):
            c = list(b)
            if c and rng.random() < 0.7:
                c[rng.randrange(len(c))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(c)))
    rows += [(500, None), (501, ""), (502, "ONE two"), (503, "one\ttwo"), (504, "Ünï x y z")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert all(got[i]["fp0"] % (1 << 64) == p for i, p in prints.items())
    want = brute_components(sorted(prints), prints)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert len(set(want.values())) < len(rows)


def test_masks_cover_every_pair_within_the_radius():
    masks = [m % (1 << 64) for m in simhash.covering_masks(3)]
    rng = random.Random(2)
    for _ in range(3000):
        d = 0
        for b in rng.sample(range(64), 3):
            d |= 1 << b
        assert any(d & m == 0 for m in masks)
    assert len(masks) == 15 and min(m.bit_count() for m in masks) >= 30


def test_crowded_buckets_are_dealt_into_cells(spark):
    rng = random.Random(9)
    fps = {0}
    while len(fps) < 400:
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(20), rng.choice([1, 2, 3, 7])):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    classes = spark.createDataFrame([(0, f, i) for i, f in enumerate(fps)], "fam int, fp long, rep long")
    scratch = simhash.Scratch(spark, "t")
    parts = simhash.connected_components(simhash.link_fingerprints(classes, scratch, cell=32), scratch)
    got = {r["node"]: r["component"] for r in parts.collect()}
    want = brute_components(list(range(len(fps))), dict(enumerate(fps)))
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_a_long_path(spark):
    scratch = simhash.Scratch(spark, "t")
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = simhash.connected_components(edges.unionByName(spark.createDataFrame([(901, 900)], "a long, b long")), scratch)
    assert {r["node"]: r["component"] for r in got.collect()} == {i: 0 for i in range(1, 200)} | {901: 900}


def test_simhash_edges(spark):
    d = docs(spark, [(5, "a b c d", 1), (5, "a b c d", 1), (None, "a b c d", 2), (9, "q r s t", 3)], "doc_id long, text string, component_id int")
    got = simhash.near_duplicates(d)
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got.collect()) == [(-1, 5), (5, 5), (5, 5), (9, 9)]
    assert simhash.near_duplicates(d.limit(0)).count() == 0
    kept = simhash.one_of_each(d, simhash.near_duplicates(d))
    assert set(kept.columns) == set(d.columns) and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 5, 5, 9]


def test_majority_in_pieces():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 300_000, dtype=np.uint64)
    lengths = np.array([0, 200_000, 1, 0, 99_999])
    got = simhash._majority(h, lengths)
    ends = np.cumsum(lengths)
    for n, e, g in zip(lengths, ends, got, strict=True):
        part = h[e - n : e]
        want = sum(1 << b for b in range(64) if n and 2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) > n)
        assert int(g) == want


def test_families_of_fingerprints_link_by_any(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(80))) for i in range(10)]
    rows += [(i + 100, t.replace(t.split()[40], "zz", 1)) for i, t in rows]
    one = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), shingle=5).collect()}
    many = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), shingle=5, seeds=(42, 43, 44, 45, 46)).collect()}
    assert len(set(many.values())) <= len(set(one.values()))
    prints = [{i: brute_print(t, 5, s) for i, t in rows} for s in (42, 43, 44, 45, 46)]
    ids = sorted(i for i, _ in rows)
    low = {i: i for i in ids}

    def find(x):
        return x if low[x] == x else find(low[x])

    for p in prints:
        for i, c in brute_components(ids, p).items():
            a, b = sorted((find(i), find(c)))
            low[b] = a
    assert many == {i: find(i) for i in ids}


def jaccard(a, b, k=5):
    sh = lambda t: {" ".join(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))}
    return len(sh(a) & sh(b)) / len(sh(a) | sh(b))


def test_verified_links_are_similar_and_few_are_missed(spark):
    rng = random.Random(21)
    vocab = ["w%d" % i for i in range(400)]
    rows, origin = [], {}
    for g in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        for c in range(5):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4]) if c else 0):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            origin[len(rows)] = g
            rows.append((len(rows), " ".join(own)))
    text = dict(rows)
    shuffled = text[0].split()
    rng.shuffle(shuffled)
    rows += [(900, " ".join(shuffled)), (901, None), (902, ""), (903, "one two"), (904, "two one")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.verified_duplicates(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and got[900] == 900 and got[903] != got[904] and got[901] == got[902]
    assert all(origin[i] == origin[c] for i, c in got.items() if i in origin)
    want = [(i, j) for i in origin for j in origin if i < j and jaccard(text[i], text[j]) >= 0.8]
    assert np.mean([got[i] == got[j] for i, j in want]) > 0.95
    assert simhash.verified_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_paths_of_links_join_in_any_order():
    for seed in range(200):
        rng = random.Random(seed)
        n = rng.randint(2, 40)
        path = rng.sample(range(n), n)
        pairs = list(zip(path, path[1:], strict=False))
        rng.shuffle(pairs)
        labels = np.arange(n)
        for a in range(0, len(pairs), 7):
            x, y = np.array(pairs[a : a + 7]).T
            simhash._linked(x, y, labels)
        assert (labels == 0).all()


def edited_copies(seed, groups, copies):
    """Texts in groups, each copy edited until about 0.8 of its shingles are the original's."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = ["w%d" % int(rng.paretovariate(0.9)) for _ in range(rng.randint(60, 300))]
        for c in range(copies):
            own = list(base)
            for at in rng.sample(range(len(own)), rng.randint(len(own) // 100, len(own) // 45) if c else 0):
                own[at] = "v%d" % rng.randint(1, 10_000)
            rows.append((len(rows), " ".join(own)))
    return rows


def similar_components(rows, least=0.8):
    sets = {i: {" ".join(t.split()[a : a + 5]) for a in range(max(1, len(t.split()) - 4))} for i, t in rows}
    pairs = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in sets for j in sets if i < j and sets[i] & sets[j]]
    low = {i: i for i in sets}

    def find(x):
        return x if low[x] == x else find(low[x])

    for i, j, s in pairs:
        if s >= least:
            a, b = sorted((find(i), find(j)))
            low[b] = a
    return {i: find(i) for i in sets}, [p for p in pairs if p[2] >= least]


@pytest.mark.parametrize("how", [{}, {"crowd": 4, "block": 8}])
def test_every_similar_pair_of_a_group_joins_its_members(spark, how):
    rows = edited_copies(31, 6, 40)
    want, _ = similar_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.verified_duplicates(docs(spark, rows), **how).collect()}
    assert got == want and 6 < len(set(want.values())) < len(rows)


def test_equal_words_and_pairs_are_not_enough(spark):
    rows = [(1, "a b c a b c b a c " * 2 + "a c b a"), (2, "a c b a c a b c b " * 2 + "a b c a")]
    pairs = lambda t: (set(t.split()), set(zip(t.split(), t.split()[1:], strict=False)))
    assert pairs(rows[0][1]) == pairs(rows[1][1]) and jaccard(rows[0][1], rows[1][1]) < 0.8
    assert [r["component_id"] for r in simhash.verified_duplicates(docs(spark, rows)).orderBy("doc_id").collect()] == [1, 2]


def test_no_pair_near_the_threshold_is_missed(spark):
    rows = edited_copies(32, 300, 2)
    _, pairs = similar_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.verified_duplicates(docs(spark, rows)).collect()}
    assert sum(s < 0.85 for _, _, s in pairs) > 30 and [got[i] == got[j] for i, j, _ in pairs] == [True] * len(pairs)


def test_fingerprints_link_near_copies_before_any_other_step(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROUNDS", 0)
    monkeypatch.setattr(simhash, "_candidates", lambda least: lambda batches: (x for b in batches for x in ()))
    rng = random.Random(41)
    rows = []
    for i in range(60):
        base = ["w%d" % rng.randint(1, 2000) for _ in range(rng.randint(100, 400))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:50], "edited", *base[51:]]))]
    tails = [" ".join("%s%d" % (x, k) for k in range(12)) for x in "uv"]
    rows += [(500, "p q r " * 80 + tails[0]), (501, "p q r " * 80 + tails[1])]
    prints = {i: brute_print(t, 3, 42) for i, t in rows}
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3
    linked = [i for i in range(0, 120, 2) if near(i, i + 1)]
    assert 20 < len(linked) < 60 and near(500, 501) and jaccard(rows[-2][1], rows[-1][1]) < 0.8
    got = {r["doc_id"]: r["component_id"] for r in simhash.verified_duplicates(docs(spark, rows)).collect()}
    assert got == {i: i - 1 if i % 2 and i - 1 in linked else i for i, _ in rows}


def test_a_sieve_passes_all_its_ids_and_few_others(spark):
    scratch = simhash.Scratch(spark, "sieve")
    ids = scratch.save(spark.range(-3000, 3000).unionByName(spark.createDataFrame([(None,)], "id long")), "ids")
    shared = spark.sparkContext.broadcast(simhash._sieve(ids.filter("id is null or id % 3 = 0")))
    got = [{r["id"] for r in ids.select("id", simhash._slot()).mapInArrow(simhash._sifted(shared, p), "id long").collect()} for p in (True, False)]
    own = {None, *range(-3000, 3000, 3)}
    assert own <= got[0] and len(got[0]) < len(own) + 20 and got[1] == {None, *range(-3000, 3000)} - got[0]


def test_members_come_back_as_they_were_packed():
    m = np.zeros(7, simhash._MEMBER)
    m["h"], m["id"], m["at"], m["n"] = np.arange(7, dtype=np.uint64) << np.uint64(61), np.arange(7) - 3, range(7), 1 << np.arange(7)
    assert (simhash._members(simhash._packed_members(m)) == m).all()


def test_components_of_few_edges_are_written_to_few_files(spark, monkeypatch, tmp_path):
    from verispark.llm import components
    from verispark.llm.common import Scratch

    written, save = [], Scratch.save

    def counted(self, df, tag, by=None):
        out = save(self, df, tag, by)
        written.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(i, i - 1) for i in range(1, 200) if i % 10], "a long, b long")
        got = {r["node"]: r["component"] for r in components.connected_components(edges, Scratch(spark, "few")).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {i: i // 10 * 10 for i in range(200) if i % 10}
    assert len(written) > 4 and max(written[1:]) <= components.FILES
