import importlib
import random
import re

import pytest
import corpus_pipeline as P
from verispark.llm import queries

VOCAB = ["w%03d" % i for i in range(500)]
STOP = "the of and to in is that it was for on are with as be this from by".split()


def sentence(rng, n):
    return " ".join(rng.choice(STOP) if rng.random() < 0.4 else rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(33)
    rows, kind = [], {}

    def add(text, what):
        kind[len(rows)] = what
        rows.append((len(rows), text, "en", f"src{len(rows) % 3}", len(text or "")))

    items = [(i, sentence(rng, 30)) for i in range(5)]
    base = [sentence(rng, rng.randint(60, 400)) for _ in range(60)]
    for t in base:
        add(t, "clean")
    for t in base[:10]:
        add(t.replace(" ", "\n\t ", 3), "exact copy")
    for t in base[10:30]:
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        add(" ".join(w), "near copy")
    for i, t in items:
        add(sentence(rng, 50) + " " + t + " " + sentence(rng, 50), "leak")
    for t in ("", None, "123 456 !!", "   "):
        add(t, "no language")
    add(" ".join(base[40:60]) * 4, "long")
    d = tmp_path_factory.mktemp("data")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), rows, kind


def test_stages_take_effect(spark, folder):
    d, rows, kind = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, {r[0] for r in rows}
    gone = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.collect()}
        gone[name], kept = kept - now, now
    of = lambda what: {i for i, k in kind.items() if k == what}
    assert gone["language"] == of("no language") and gone["exact copies"] == of("exact copy") and gone["benchmark leaks"] == of("leak")
    assert gone["near copies"] <= of("near copy") and len(gone["near copies"]) >= 0.9 * len(of("near copy"))
    packed = P.STAGES[-1][1](spark, docs, d).collect()
    assert {r["doc_id"] for r in packed} == kept
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    whole = P.run(spark, d).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_pipeline_over_nothing(spark, folder, tmp_path):
    d, _, _ = folder
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in queries.QUERIES
    entry = importlib.import_module("__spark_entry__")
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
