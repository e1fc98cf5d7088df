import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verispark.llm import decontaminate, language_gru, quality_nbsvm, secret_scan, toxicity_grammar, url_filter
from verispark.llm.common import crc_mod

EN = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_urls(spark):
    urls = ["http://a.net/x", "https://Example.NET/en/1?q#z", "http://m.example.net/de/", "http://evilnet/", "https://example.com/de/1", "http://example.com/en/", "http://x.org/fr/2", "http://org/fr/", "http://net?x", "no scheme", None, "", "http://net/", "ftp://u@a.net:80/p?://b.org/fr/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, host string")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert len(got) == len(urls) + 1

    def brute(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fit = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda r: len(r[0]), default=(None, "allow"))
        return host, path, *best

    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(urls[r["page_id"]])


def test_urls_with_many_rules_and_none(spark):
    rng = random.Random(1)
    rules = [(rng.choice(["block", "allow"]), ".".join(rng.choice("abc") for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))) for _ in range(60)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    urls = ["http://" + ".".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 6))) for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, rules)).collect():
        fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        want = max(fit, default=(0, 0, 0, None, "allow"))
        assert (r["rule"], r["verdict"]) == want[3:]
    assert {r["verdict"] for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, [])).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, rules)).count() == 0


def base_spans(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out))


def test_base_secrets_against_python(spark):
    rng = random.Random(3)
    bits = ["password", "token", "Secret", "api_key", "apikey", "=", ": ", ' = "', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", " ", "\n", "é", "😀", "abcdefghijkl", "x", "=abc.def-ghi", "AKIAAKIA"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)] + [(900, None), (901, ""), (902, "token: secret = abcdefghijklmnop"), (903, "pad " * 30_000 + "AKIA" + "Z" * 20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.secret_digest(secret_scan.scan_secrets(d)).collect()}
    for i, t in rows:
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (t, got[i]["spans"], want)
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [len(re.findall(rf"{k}:", want)) for k in ("assign", "access", "hex")]
        assert set(filter(None, want.split(","))) <= set(filter(None, got[i]["spans"].split(",")))


def test_weak_parts_need_a_partner_nearby(spark):
    opaque = "aB3dE5gH7jK9mN1pQ3sT"
    rows = [(1, f"host db://h.example/x key {opaque}"), (2, f"key {opaque}"), (3, f"db://h.example/x {'pad ' * 200}{opaque}"), (4, f"username=alice and {opaque}"), (5, "AKIA" + "Q" * 16 + f" with {opaque}"), (6, f"{opaque} or {opaque[::-1]}")]
    d = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, base string")
    got = {r["doc_id"]: {s["kind"] for s in r["linked"]} for r in secret_scan.scan_secrets(d).collect()}
    assert got == {1: {"opaque", "endpoint"}, 2: set(), 3: set(), 4: {"login", "opaque"}, 5: {"opaque"}, 6: set()}
    assert secret_scan.scan_secrets(d.limit(0)).count() == 0


def test_leaks(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, [*EN, *DE], n)) for i, n in enumerate([20, 35, 50, 12, 3])] + [(90, None), (91, "")]
    text = dict(items)
    rows = [(0, prose(rng, EN, 300)), (1, "x " * 50 + text[0] + " y" * 50), (2, text[1].upper().replace(" ", "\n")), (3, text[2]), (4, "start " + text[3] + " and " + text[0]), (5, None), (6, ""), (7, " ".join(text[2].split()[:20])), (8, "z " + text[4] + " z"), (9, ("filler " * 40_000) + text[1])]
    d, b = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(d, b).collect()}
    assert set(got) >= {(1, 0), (2, 1), (3, 2), (4, 3), (4, 0), (8, 4), (9, 1)} and not {k for k in got if k[0] in (0, 5, 6, 7)} - {(0, 4)}
    assert got[1, 0]["first_word"] == 50 and got[1, 0]["n_words"] == 20 and got[1, 0]["similarity"] == 1
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(d, b).collect()}
    assert {0, 5, 6, 7} - kept <= {0} and not kept & {1, 2, 3, 4, 9}
    assert decontaminate.find_leaks(d.limit(0), b).count() == 0 and decontaminate.find_leaks(d, b.limit(0)).count() == 0


def test_leak_windows_against_all_windows():
    rng = random.Random(8)
    items = [(i, prose(rng, EN[:12], rng.randint(6, 25))) for i in range(12)]
    index = decontaminate.Index(items, 5, 64)  # every fingerprint is within the radius
    for _ in range(20):
        words = prose(rng, EN[:12], 60).split()
        i, t = rng.choice(items)
        own = t.split()
        own[rng.randrange(len(own))] = "changed" if rng.random() < 0.5 else own[0]
        words[10:10] = own
        got = {m[0]: m[3] for m in index.matches(" ".join(words), 0.6)}
        want = {}
        for j, u in items:
            w = u.split()
            g = Counter(decontaminate.shingles_of(w))
            best = max((decontaminate.similarity(Counter(decontaminate.shingles_of(words[a : a + len(w)])), g) for a in range(len(words) - len(w) + 1)), default=0)
            if best >= 0.6:
                want[j] = best
        assert got == pytest.approx(want)


def test_multi_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(0)
    index = decontaminate.Index([(i, " ".join(f"w{i}x{j}" for j in range(10))) for i in range(50)], 5, 15)
    prints = index.prints.copy()
    for k in range(len(prints)):
        for b in rng.choice(64, rng.integers(0, 16), replace=False):
            prints[k] ^= np.uint64(1) << np.uint64(b)
    found = {tuple(x) for x in index.within(prints, 10).tolist()}
    near = np.bitwise_count(prints[:, None] ^ index.prints[None]) <= 15
    assert found == set(zip(*map(list, np.nonzero(near)), strict=True))


def test_language(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, EN if i % 2 else DE, rng.randint(1, 60)), "en" if i % 2 else "de") for i in range(400)]
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (1003, prose(rng, DE, 20_000), None), (None, "the of and", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_gru.fit(d, crc_mod(F.col("doc_id"), 4) != 2, sample=100)
    got = {r["doc_id"]: r for r in language_gru.identify(d, model).collect()}
    held = [i for i, _, _ in rows[:400] if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in held]) > 0.93
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"] and all(0 <= r["score"] <= 1 for r in got.values())
    kept = [r["doc_id"] for r in language_gru.drop_rejected(d, model).collect()]
    assert len(kept) == 402 and None in kept and 1001 not in kept
    nothing = language_gru.fit(d.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_gru.identify(d, nothing).collect()} == {"und"}


def test_network_gradients():
    rng = np.random.default_rng(0)
    p = language_gru._init(3, 2, rng)
    x = rng.integers(0, 256, (5, 2))
    target = rng.normal(size=(5, 2, 3)).astype(np.float32)

    def loss(emb, rec):
        past, _, last = language_gru._forward(x, emb, rec, 3)
        return float(((np.stack([*past[1:], last]) * target)).sum())

    past, gates, last = language_gru._forward(x, p["Ef"].astype(np.float64), p["Uf"].astype(np.float64), 3)
    ge, gu = np.zeros_like(p["Ef"], dtype=float), np.zeros_like(p["Uf"], dtype=float)
    language_gru._backward(x, p["Uf"].astype(np.float64), past, gates, target.astype(np.float64), 3, ge, gu)
    for a, g in ((p["Uf"].astype(float), gu), (p["Ef"].astype(float), ge)):
        for at in [(0, 0), (1, 4), (2, 8), (x[0, 0] % a.shape[0], 5)]:
            e = 1e-3
            up, down = a.copy(), a.copy()
            up[at] += e
            down[at] -= e
            args = (lambda m: (p["Ef"].astype(float), m)) if a.shape == p["Uf"].shape else (lambda m: (m, p["Uf"].astype(float)))
            assert g[at] == pytest.approx((loss(*args(up)) - loss(*args(down))) / (2 * e), abs=2e-2)


def test_fast_labeller_equals_the_trained_network():
    rng = np.random.default_rng(1)
    p = language_gru._init(4, 3, rng)
    x = rng.integers(0, 256, (9, 5))
    x[6:, 2] = 256
    pf, _, lf = language_gru._forward(x, p["Ef"], p["Uf"], 4)
    pb, _, lb = language_gru._forward(x[::-1], p["Eb"], p["Ub"], 4)
    logit = np.concatenate([np.stack([*pf[1:], lf]), np.stack([*pb[1:], lb])[::-1]], 2) @ p["W"] + p["c"]
    prob = np.exp(logit) / np.exp(logit).sum(2, keepdims=True) * (x < 256)[:, :, None]
    assert np.allclose(language_gru.Labeller(p, 4)(x), prob.sum(0), atol=1e-4)


def labelled(spark, n=400):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        good, toxic = i % 3 != 0, i % 5 == 0
        words = prose(rng, EN, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "you " + rng.choice(["zork", "zorkling", "blarg"]) + ".")
        t = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, t))
        labels.append((i, int(good), int(toxic)))
    docs += [(9000, None), (9001, ""), (9002, "a b " * 50_000)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (5, 1, 1), (None, 1, 0), (7777, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    d, lab = labelled(spark)
    model = quality_nbsvm.fit(d, lab, crc_mod(F.col("id"), 5) != 0, sample=100)
    got = {r["doc_id"]: r for r in quality_nbsvm.score_quality(d, model).collect()}
    assert np.mean([got[i]["predicted"] == (i % 3 != 0) for i in range(400)]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 403
    const = quality_nbsvm.fit(d, lab.limit(0), F.lit(True))
    assert {r["score"] for r in quality_nbsvm.score_quality(d, const).collect()} == {0.5}


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(60)]
    y = np.where(np.array([(r < 12).sum() for r in rows]) >= 4, 1.0, -1.0)
    scale = rng.normal(1, 0.2, 30)
    w = quality_nbsvm.dual_coordinate_descent(rows, scale, y, c=0.1, epochs=300)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum())
    x[:, -1] = 1
    caps = 0.1 * 10 * np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    primal = lambda v: 0.5 * v @ v + (caps * np.maximum(0, 1 - y * (x @ v))).sum()
    best = primal(w)
    assert all(best <= primal(w + rng.normal(0, 0.03, 31)) + 1e-3 for _ in range(200))


def test_features_of_long_texts_are_whole(monkeypatch):
    f = quality_nbsvm.Features(1 << 12)
    t = bytes(np.random.default_rng(1).integers(32, 127, 5000, dtype=np.uint8))
    want = f.of(t)
    monkeypatch.setattr(quality_nbsvm, "PIECE", 700)
    assert (f.of(t) == want).all() and not f.seen.any() and f.of(b"").size == 0


def test_toxicity(spark):
    d, lab = labelled(spark)
    model = toxicity_grammar.fit(d, lab, crc_mod(F.col("id"), 5) != 0, sample=200)
    got = {r["doc_id"]: r for r in toxicity_grammar.score_toxicity(d, model).collect()}
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in range(400)]) > 0.98
    assert got[9000]["predicted"] == got[9001]["predicted"] == 0 and len(got) == 403
    none = toxicity_grammar.fit(d, lab.limit(0), F.lit(True))
    assert {r["predicted"] for r in toxicity_grammar.score_toxicity(spark.createDataFrame([(1, "the of"), (2, "you idiot. you moron. stupid you.")], "doc_id long, text string"), none).orderBy("doc_id").collect()} == {0, 1}


def test_grammar_reads_clauses_not_words():
    g = toxicity_grammar.Grammar({w: s for s, ws in toxicity_grammar.SEEDS.items() for w in ws.split()}, {})
    event = lambda t: {k for _, _, e, _ in g.matched(t) for k in [("event", (e - 1) // 8, "negated", bool((e - 1) & 4), "reported", bool((e - 1) & 2), "targeted", bool((e - 1) & 1))]}
    one = lambda kind, neg, rep, tgt: {("event", kind, "negated", neg, "reported", rep, "targeted", tgt)}
    assert event("You are an idiot.") == one(0, False, False, True)
    assert event("That idiot") == one(0, False, False, False)
    assert event("You are not an idiot.") == one(0, True, False, True)
    assert event('She said that man is a fool and an idiot') == one(0, False, True, False)
    assert event("I will destroy you") == one(1, False, False, True)
    assert event("idiotic plans. Nothing here.") == set()
    assert len(g.matched("idiot. moron! scum")) == 3 and g.matched("") == []


@pytest.mark.parametrize("gone", [[0, 1, 2], [57, 58, 59], [30]])
def test_documents_shorter_than_the_item_they_hold(gone):
    rng = random.Random(12)
    item = prose(rng, [*EN, *DE], 60)
    words = [w for i, w in enumerate(item.split()) if i not in gone]
    index = decontaminate.Index([(7, item), (8, prose(rng, EN, 60))], 5, 15)
    want = decontaminate.similarity(Counter(decontaminate.shingles_of(words)), Counter(decontaminate.shingles_of(item.split())))
    assert want >= 0.8 and index.matches(" ".join(words), 0.8) == [(7, 0, len(words), want)]
    assert index.matches(" ".join(words[:30]), 0.8) == []


def test_long_weak_parts_are_linked_whole(spark):
    key, login, url = "aB3dE5gH7jK" * 8, "login=" + "n" * 100, "db://h.example/" + "p" * 400
    rows = [(1, f"{url} {key} end"), (2, f"{login} and {key}+/{key}"), (3, f"{key} {key}"), (4, f"{key[:64]} {url}"), (5, f"{login} {'pad ' * 80}{key * 9} {url}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: {dict(rows)[r["doc_id"]][s["start"] : s["end"]] for s in r["linked"]} for r in secret_scan.scan_secrets(d).collect()}
    assert got == {1: {url, key}, 2: {login, f"{key}+/{key}"}, 3: set(), 4: {key[:64], url}, 5: {key * 9, url}}


def test_first_rows_of_each_label_by_place(spark, monkeypatch):
    ids = list(range(3000))
    lab = spark.createDataFrame([(i, int(i % 10 == 0)) for i in ids] + [(5, 1), (7, 0), (None, 1), (8, 9), (20, 1)], "doc_id long, quality int")
    d = spark.createDataFrame([(i, str(i), "x") for i in ids] + [(20, "again", "x"), (None, "none", "x")], "doc_id long, text string, label string")
    got = quality_nbsvm.labelled_sample(d, lab, "quality", "doc_id", "text", F.col("id") != 0, 40).select("id", "text", "label", "of").collect()
    place = {r["id"]: r["p"] for r in spark.range(3000).select("id", F.shiftrightunsigned(F.xxhash64("id"), 33).alias("p")).collect()}
    for label, of in ((1, 299), (0, 2699)):
        own = [i for i in ids if i not in (0, 5) and (i % 10 == 0) == label]
        assert {r["id"] for r in got if r["label"] == label} == set(sorted(own, key=lambda i: (place[i], i))[:40]) and {r["of"] for r in got if r["label"] == label} == {len(own)}, of
    assert quality_nbsvm.labelled_sample(d, lab.limit(0), "quality", "doc_id", "text", F.lit(True), 40).count() == 0


def test_classifiers_over_nothing_repeats_and_clashing_columns(spark):
    d, lab = labelled(spark, 120)
    d = d.unionByName(d.filter("doc_id in (1, 9000)")).withColumns({"score": F.lit("s"), "label": F.lit(3), "id": F.lit("x"), "quality": F.lit(0)})
    for module, score in ((quality_nbsvm, quality_nbsvm.score_quality), (toxicity_grammar, toxicity_grammar.score_toxicity)):
        model = module.fit(d, lab, F.lit(True), sample=50)
        got = score(d, model).collect()
        assert len(got) == 125 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and score(d.limit(0), model).count() == 0
        assert score(d, module.fit(d.limit(0), lab, F.lit(True))).count() == 125


@pytest.mark.parametrize("between", [3, 20, 600, 30_000])
def test_clauses_of_any_length(between):
    g = toxicity_grammar.Grammar({w: s for s, ws in toxicity_grammar.SEEDS.items() for w in ws.split()}, {})
    pad = " ".join(["pad"] * between)
    flags = lambda t: [((e - 1) // 8, bool((e - 1) & 4), bool((e - 1) & 2), k) for _, _, e, k in g.matched(t)]
    assert flags(f"she said that {pad} you idiot") == [(0, False, True, 1)]
    assert flags(f"{pad} you idiot {pad} you moron") == [(0, False, False, 2)]
    assert flags(f"he wrote. {pad} not an idiot; {pad} destroy you") == [(0, True, False, 1), (1, False, False, 1)]


def test_roles_are_learned_from_the_side_of_the_target(spark):
    rng = random.Random(2)
    rows = [(i, f"{prose(rng, EN[:9], 8)}. {rng.choice(['you are a blarg', 'i will zorkify you now', 'you blarg'])}. ", 1, 60) for i in range(60)] + [(100 + i, prose(rng, EN, 20), 0, 60) for i in range(60)]
    words, stems = toxicity_grammar.learn_lexicon(spark.createDataFrame(rows, "id long, text string, label int, of long"))
    assert words["blarg"] == "insult" and words["zorkify"] == "threat" and {stems[s] for s in stems if "zorkify".startswith(s)} <= {"threat"}


def near_item(rng, words, least):
    """A copy with a few words changed, whose weighted similarity is still at ``least``."""
    own = list(words)
    want = decontaminate.similarity(Counter(decontaminate.shingles_of(own)), Counter(decontaminate.shingles_of(words)))
    while True:
        new = list(own)
        new[rng.randrange(len(new))] = f"n{rng.randrange(999)}"
        s = decontaminate.similarity(Counter(decontaminate.shingles_of(new)), Counter(decontaminate.shingles_of(words)))
        if s < least:
            return own, want
        own, want = new, s
        if rng.random() < 0.2:
            return own, want


def test_fingerprints_within_the_radius_hold_the_similar_windows():
    rng = random.Random(77)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, prose(rng, vocabulary, rng.randint(40, 150))) for i in range(150)]
    index, met = decontaminate.Index(items, 5, decontaminate.RADIUS), 0
    for i, t in items:
        own, s = near_item(rng, t.split(), 0.8)
        got = index.matches(prose(rng, vocabulary, 30) + " " + " ".join(own) + " " + prose(rng, vocabulary, 30), 0.8)
        met += (i in {m[0] for m in got}) and dict((m[0], m[3]) for m in got)[i] >= s - 1e-9
    assert met >= 0.98 * len(items)


def test_leak_query_against_every_window(spark):
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(120)]
    items = [(i, prose(rng, vocabulary, rng.randint(8, 40))) for i in range(30)]
    rows = []
    for i in range(120):
        words = prose(rng, vocabulary, rng.randint(5, 90)).split()
        for _ in range(rng.randint(0, 2)):
            own, _ = near_item(rng, rng.choice(items)[1].split(), 0.75)
            at = rng.randrange(len(words))
            words[at:at] = own
        rows.append((i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d = d.unionByName(spark.createDataFrame([(None, items[0][1]), (None, "clean"), (3, rows[3][1])], "doc_id long, text string")).withColumns({"_id": F.lit(1), "item_id": F.lit(2), "gone": F.lit(3)})
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(d, b).collect() if r["doc_id"] is not None}
    want = {}
    for i, t in rows:
        words = t.split()
        for j, u in items:
            n, g = len(u.split()), Counter(decontaminate.shingles_of(u.split()))
            best = max(decontaminate.similarity(Counter(decontaminate.shingles_of(words[a : a + n])), g) for a in range(max(1, len(words) - n + 1)))
            if best >= 0.8:
                want[i, j] = best
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and all(got[k] <= want[k] + 1e-9 for k in got) and len(want) > 40
    kept = decontaminate.drop_leaks(d, b)
    assert kept.columns == d.columns and sorted((r["doc_id"] is None, r["text"]) for r in kept.collect() if r["doc_id"] is None) == [(True, "clean")]
    assert {r["doc_id"] for r in kept.collect()} - {None} == {i for i, _ in rows} - {k[0] for k in got}


def linked_by_hand(text, scope=secret_scan.SCOPE):
    parts = []
    for kind, role, pattern in (("assign", "secret", secret_scan.ASSIGN), ("access", "id", secret_scan.ACCESS), ("hex", "secret", secret_scan.HEX)):
        for m in re.finditer(pattern, text, re.A):
            if (kind != "assign" or len(m[2]) >= 12) and (kind != "access" or len(m[0]) >= 18):
                parts.append((m.start(), m.end(), kind, role, False))
    base = list(parts)
    for kind, role, pattern in secret_scan.WEAK:
        parts += [(m.start(), m.end(), kind, role, True) for m in re.finditer(pattern, text, re.A) if not any(a < m.end() and m.start() < z for a, z, *_ in base)]
    return {p[:3] for p in parts if p[4] and any(o[3] != p[3] and o[0] <= p[1] + scope and p[0] <= o[1] + scope for o in parts)}


def test_links_against_all_pairs_of_parts(spark):
    rng = random.Random(31)
    bits = ["user=alice", "login: bob99", "aB3dE5gH7jK9mN1pQ3sT", "Zz9" * 9, "db://h.example/x", "https://a.b/c?d", "AKIA" + "Q" * 16, "0123456789abcdef0", "password = abcdefghijkl", "short=1"]
    texts = [" ".join(x for _ in range(rng.randint(0, 14)) for x in (rng.choice(bits), "p" * rng.choice([1, 30, 120, 255, 256, 257, 300]))) for _ in range(150)]
    d = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    got = secret_scan.scan_secrets(d).collect()
    assert len(got) == 151 and sum(len(r["linked"]) for r in got) > 100
    for r in got:
        assert {(s["start"], s["end"], s["kind"]) for s in r["linked"]} == linked_by_hand(texts[r["doc_id"]])


def test_thousands_of_spans_in_one_text(spark):
    t = " ".join(f"{'é' * (i % 7)} token=abcdefghijkl{i} {'f' * 16}" for i in range(6000))
    r = secret_scan.secret_digest(secret_scan.scan_secrets(spark.createDataFrame([(1, t)], "doc_id long, text string"))).head()
    assert r["n_assign"] == r["n_hex"] == 6000 and r["base_sha256"] == hashlib.sha256(base_spans(t).encode()).hexdigest()


def test_stages_keep_clashing_columns(spark):
    from verispark.llm import exact_dedup, simhash

    rng = random.Random(3)
    rows = [(i, prose(rng, EN, 40)) for i in range(12)]
    rows += [(20, rows[0][1]), (None, rows[1][1]), (None, "only here words enough to be a text of its own")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_id", "gone", "found", "own_sha", "_sha_of", "letters", "id")})
    model = ({}, [], 8)
    for out, ids in ((exact_dedup.drop_copies(d), {*range(12), None}), (simhash.one_of_each(d, simhash.verified_duplicates(d)), {*range(12), None}), (language_gru.drop_rejected(d, model), {*range(12), 20, None})):
        assert out.columns == d.columns and {r["doc_id"] for r in out.collect()} == ids
        assert all(r["own_sha"] == "own_sha" and r["letters"] == "letters" for r in out.collect())
