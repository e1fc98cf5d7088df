import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from verispark.llm import packing, queries, token_files
from verispark.llm.memo_encoder import MemoEncoder
from verispark.llm.repair import Shard, compress, pack_shard

ODD = ["", " ", "  a  b\n\nc ", "It's 123 don't\t\tx", "ΣΑΣ İstanbul", "日本語 テキスト한국", "a\x1cb c", "école naïve", "<|endoftext|> hi", "😀 emoji 👍🏽", " x y", "ﬁne ½ ² Ⅷ", " 's", "x'S 'RE", "é café", "a\r\n\r\nb", "\x00\x7f", "ßÿþ × ÷ ª"]


def real(name):
    t = Tokenizer.from_file(queries.tokenizer_path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", [queries.BYTE_FILE, queries.WORD_FILE])
def test_memory_gives_the_ids_of_a_plain_call_over_all_planes(name):
    rng = random.Random(9)
    enc, tok = MemoEncoder(queries.tokenizer_path(name), most=300, added=True), Tokenizer.from_file(queries.tokenizer_path(name))
    blocks = [(0, 0x7F), (0, 0x250), (0x250, 0x600), (0x600, 0x1100), (0x1100, 0x2C00), (0x2C00, 0xD800), (0xE000, 0x10000), (0x10000, 0x20000), (0x20000, 0x110000)]
    for _ in range(40):
        texts = ["".join(chr(rng.randrange(*blocks[0 if rng.random() < 0.6 else rng.randrange(len(blocks))])) for _ in range(rng.randrange(60))) + rng.choice(["", "", "<|endoftext|>", " <|startoftext|> x", "\u0301"]) for _ in range(30)]
        ids, n = enc.encode(texts)
        at = np.r_[0, np.cumsum(n)]
        assert [ids[a:z].tolist() for a, z in zip(at, at[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.start) <= 300 + len(enc.passing)


@pytest.mark.parametrize("seed", range(3))
def test_no_pair_stays_frequent(seed):
    rng = np.random.default_rng(seed)
    ids = np.r_[rng.zipf(1.4, 30_000).clip(3, 2000), np.full(3000, 9), np.tile([5, 5, 5, 6], 200)].astype(np.int32)
    ends = np.r_[np.sort(rng.choice(len(ids), 40)), len(ids)]
    seq, seq_ends, rules = compress(ids, ends, 2001, least=6)
    inner = np.ones(len(seq), bool)
    inner[seq_ends[seq_ends > 0] - 1] = False
    codes, n = np.unique(seq[:-1][inner[:-1]].astype(np.int64) << 32 | seq[1:][inner[:-1]], return_counts=True)
    assert n.max() < 6 and len(rules) < 6000 and (rules.max(axis=1) < 2001 + np.arange(len(rules))).all()


@pytest.mark.parametrize("name", [queries.BYTE_FILE, queries.WORD_FILE])
def test_memory_gives_the_librarys_ids(name):
    enc, tok = MemoEncoder(queries.tokenizer_path(name), most=20), real(name)
    for _ in range(3):
        ids, n = enc.encode(ODD)
        at = np.r_[0, np.cumsum(n)]
        assert [ids[a:z].tolist() for a, z in zip(at, at[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in ODD]
    assert enc.encode([])[0].tolist() == []


@pytest.mark.parametrize("seed", range(4))
def test_shards_round_trip_at_random(seed):
    rng = np.random.default_rng(seed)
    ids = rng.zipf(1.3, 20_000).clip(3, 3000).astype(np.int32)
    ids[5000:6000] = 7
    ends = np.r_[0, 0, np.sort(rng.choice(20_000, 60)), 20_000, 20_000]
    data = pack_shard(ids, ends, 3001, least=4)
    s = Shard(data)
    assert (s.all_ids() == ids).all() and len(s.rules) and s.docs == len(ends)
    starts = np.r_[0, ends[:-1]]
    for i, (a, z) in enumerate(zip(starts, ends, strict=True)):
        assert (s.document(i) == ids[a:z]).all()
        if z - a > 10:
            assert (s.document(i, 3, 9) == ids[a + 3 : a + 9]).all() and (s.document(i, 0, 1) == ids[a : a + 1]).all()
    sizes = {k: len(s._expand(np.array([s.first + k]))) for k in range(0, len(s.rules), 37)}
    assert all(s.sizes[k] == n for k, n in sizes.items())


def test_empty_shard_and_wrong_bytes():
    assert Shard(pack_shard(np.zeros(0, np.int32), np.array([0]), 10)).all_ids().tolist() == []
    with pytest.raises(ValueError):
        Shard(b"12345678" + bytes(48))


def test_token_files_against_the_library(spark):
    rows = [(i * 3 % 17, t) for i, t in enumerate(ODD[:17])] + [(40, None), (41, "long text " * 3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in token_files.token_digest(d, queries.tokenizer_path(queries.BYTE_FILE), 2, 50257).collect()}
    tok, at = real(queries.BYTE_FILE), 0
    for i, t in sorted(rows):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_small_shards_nulls_and_empty_tables(spark, tmp_path):
    d = spark.createDataFrame([(None, "a b c", 1), (2, "d e f", 2), (2, "d e f", 3)], "doc_id long, text string, start int")
    token_files.write_token_files(d, str(tmp_path / "f"), queries.tokenizer_path(queries.BYTE_FILE), 2, 50257, shard_ids=3)
    got = sorted((r["start"], r["doc_id"]) for r in token_files.read_token_files(spark, str(tmp_path / "f")).collect())
    assert got == [(0, None), (4, 2), (8, 2)]
    assert token_files.token_digest(d.limit(0), queries.tokenizer_path(queries.BYTE_FILE), 2, 50257).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_against_the_library(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "word " * 5000), (102, "word " * 2047), (103, "word " * 2048)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(d, queries.tokenizer_path(queries.WORD_FILE), 0, with_ids=True).collect()
    tok = real(queries.WORD_FILE)
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in mine) == ids.tobytes()
        assert [r["start"] for r in mine] == list(range(0, len(ids), 2048)) and all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in mine)
    n = check_packing(got, 2048)
    assert n <= sum(r["length"] for r in got) / 2048 + 2


@pytest.mark.parametrize("seed", range(5))
def test_sweeps_are_as_good_as_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, 2000) if seed % 2 else rng.choice([34, 51, 27, 100, 1, 66], 2000)
    counts = {int(k): int((sizes == k).sum()) for k in np.unique(sizes)}
    plan, n = packing.sweep_plan(counts, 100)
    bins, placed = {}, dict.fromkeys(counts, 0)
    for size, r0, r1, first, each, place in plan:
        assert r0 == placed[size]
        placed[size] = r1
        for k in range(r1 - r0):
            bins.setdefault(first + k // each, []).append((place + k % each * size, size))
    assert placed == counts and len(bins) == n
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 100
    gaps = []
    for s in sorted(sizes.tolist(), reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= s]
        if fit:
            gaps[min(fit, key=lambda i: gaps[i])] -= s
        else:
            gaps.append(100 - s)
    assert n <= len(gaps) + 1


def test_packing_edges(spark):
    path = queries.tokenizer_path(queries.WORD_FILE)
    d = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (None, "c", 0)], "doc_id long, text string, length int")
    assert check_packing(packing.pack(d, path, 0).collect(), 2048) == 1
    assert packing.pack(d.limit(0), path, 0).count() == 0


TOLD = [*ODD, "x <|endoftext|> y", "A<|startoftext|>b  c<|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", "é<|endoftext|>\x1c İ"]


@pytest.mark.parametrize("name", [queries.BYTE_FILE, queries.WORD_FILE])
def test_added_tokens_as_in_a_plain_call(name):
    enc, tok = MemoEncoder(queries.tokenizer_path(name), most=20, added=True), Tokenizer.from_file(queries.tokenizer_path(name))
    for _ in range(3):
        ids, n = enc.encode(TOLD)
        at = np.r_[0, np.cumsum(n)]
        assert [ids[a:z].tolist() for a, z in zip(at, at[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in TOLD]


def test_queries_give_the_ids_of_a_plain_call(spark, tmp_path):
    import corpus_pipeline

    d = spark.createDataFrame(list(enumerate(TOLD)), "doc_id long, text string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    crc = lambda name, t, end: zlib.crc32(np.array([*Tokenizer.from_file(queries.tokenizer_path(name)).encode(t, add_special_tokens=False).ids, end], "<u4").tobytes())
    got = {r["doc_id"]: r["ids_crc32"] for r in queries.op5_token_files(spark, str(tmp_path)).collect()}
    assert got == {i: crc(queries.BYTE_FILE, t, queries.BYTE_END) for i, t in enumerate(TOLD)}
    for packed in (queries.op7_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, d, "")):
        assert {r["doc_id"]: r["ids_crc32"] for r in packed.collect()} == {i: crc(queries.WORD_FILE, t, queries.WORD_END) for i, t in enumerate(TOLD)}


def test_an_encoder_is_let_go():
    import weakref

    from verispark.llm import memo_encoder
    from verispark.llm.queries import WORD_FILE, tokenizer_path

    enc = memo_encoder.shared(tokenizer_path(WORD_FILE))
    enc.encode(["some words"])
    gone = weakref.ref(enc)
    del enc
    memo_encoder.release()
    assert gone() is None and not memo_encoder._SHARED
    assert len(memo_encoder.shared(tokenizer_path(WORD_FILE)).encode(["some words"])[0])
