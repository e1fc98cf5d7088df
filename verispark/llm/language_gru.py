"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of ``WINDOW`` bytes.  Every byte of every text
is labelled: texts are cut into windows, both directions run over each, and each position gets a distribution over
the languages.  A document's distribution is the mean over its positions.

The model is fitted on a bounded sample: for each language the ``SAMPLE`` rows that come first by a hash of the id, and of each
``SPOTS`` windows.  Weights are a few kilobytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verispark.llm.common import fresh
from verispark.llm.memo_encoder import release
from verispark.llm.workers import thrifty

SAMPLE = 400
SPOTS = 6
WINDOW = 64
HIDDEN = 8
STEPS = 240
BATCH = 256
ROWS = 2048
UNKNOWN = "und"
LETTER = r"\p{L}"
#: Probability of the predicted language below which a document is rejected.
LEAST = 0.5


def _init(hidden: int, classes: int, rng) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"E{d}"] = rng.normal(0, 0.5, (257, 3 * hidden))
        p[f"U{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
    p["W"] = rng.normal(0, 0.3, (2 * hidden, classes))
    p["c"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(x: np.ndarray, emb: np.ndarray, rec: np.ndarray, hidden: int):
    """x: (steps, rows).  States before each step, gates of each step, last states."""
    steps, rows = x.shape
    h = np.zeros((rows, hidden), np.float32)
    past, gates = [], []
    for t in range(steps):
        e = emb[x[t]]
        zr = 0.5 + 0.5 * np.tanh(0.5 * (e[:, : 2 * hidden] + h @ rec[:, : 2 * hidden]))
        hn = h @ rec[:, 2 * hidden :]
        n = np.tanh(e[:, 2 * hidden :] + zr[:, hidden:] * hn)
        past.append(h)
        gates.append((zr, hn, n))
        h = h + zr[:, :hidden] * (n - h)
    return past, gates, h


def _backward(x, rec, past, gates, grad_h, hidden, g_emb, g_rec) -> None:
    """grad_h: (steps, rows, hidden), the gradient on each step's state from the output."""
    carry = np.zeros_like(past[0])
    for t in reversed(range(len(past))):
        zr, hn, n = gates[t]
        h, z, r = past[t], zr[:, :hidden], zr[:, hidden:]
        d = carry + grad_h[t]
        dn = d * z * (1 - n * n)
        dz = d * (n - h) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dhn = dn * r
        g_rec += np.concatenate([h.T @ dz, h.T @ dr, h.T @ dhn], 1)
        np.add.at(g_emb, x[t], np.concatenate([dz, dr, dn], 1))
        carry = d * (1 - z) + dz @ rec[:, :hidden].T + dr @ rec[:, hidden : 2 * hidden].T + dhn @ rec[:, 2 * hidden :].T


def train(windows: np.ndarray, labels: np.ndarray, classes: int, hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 0, rate: float = 0.02) -> dict[str, np.ndarray]:
    """windows: (n, WINDOW) of bytes, 256 where there is none."""
    rng = np.random.default_rng(seed)
    p = _init(hidden, classes, rng)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        x, y = windows[pick].T, labels[pick]
        live = (x < 256).astype(np.float32)
        pf, gf, lf = _forward(x, p["Ef"], p["Uf"], hidden)
        pb, gb, lb = _forward(x[::-1], p["Eb"], p["Ub"], hidden)
        hf, hb = np.stack([*pf[1:], lf]), np.stack([*pb[1:], lb])[::-1]
        both = np.concatenate([hf, hb], 2)
        logit = both @ p["W"] + p["c"]
        prob = np.exp(logit - logit.max(2, keepdims=True))
        prob /= prob.sum(2, keepdims=True)
        d = prob
        d[:, np.arange(batch), y] -= 1
        d *= (live / live.sum())[:, :, None]
        g = {k: np.zeros_like(a) for k, a in p.items()}
        g["W"] = np.tensordot(both, d, ((0, 1), (0, 1)))
        g["c"] = d.sum((0, 1))
        dh = d @ p["W"].T
        _backward(x, p["Uf"], pf, gf, dh[:, :, :hidden], hidden, g["Ef"], g["Uf"])
        _backward(x[::-1], p["Ub"], pb, gb, dh[::-1, :, hidden:], hidden, g["Eb"], g["Ub"])
        now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


class Labeller:
    """Runs both directions over windows and sums each window's position distributions."""

    def __init__(self, p: dict[str, np.ndarray], hidden: int):
        self.h = hidden
        self.dirs = []
        for d in "fb":
            e, u = p[f"E{d}"], p[f"U{d}"]
            # the gates' sigmoid is 0.5 + 0.5 tanh(x / 2); the halves are folded in
            self.dirs.append(tuple(np.ascontiguousarray(a) for a in (0.5 * e[:, :hidden], 0.5 * e[:, hidden : 2 * hidden], e[:, 2 * hidden :], 0.5 * u[:, :hidden], 0.5 * u[:, hidden : 2 * hidden], u[:, 2 * hidden :])))
        self.wf, self.wb, self.c = np.ascontiguousarray(p["W"][:hidden]), np.ascontiguousarray(p["W"][hidden:]), p["c"]

    def _step(self, x, h, tables, a, b, c):
        ez, er, en, uz, ur, un = tables
        np.matmul(h, uz, out=a)
        a += ez[x]
        np.tanh(a, out=a)
        a *= 0.5
        a += 0.5
        np.matmul(h, ur, out=b)
        b += er[x]
        np.tanh(b, out=b)
        b *= 0.5
        b += 0.5
        np.matmul(h, un, out=c)
        c *= b
        c += en[x]
        np.tanh(c, out=c)
        c -= h
        c *= a
        h += c

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x: (steps, rows) of bytes, 256 where there is none, at the end.  (rows, classes): sums over the positions."""
        steps, rows = x.shape
        a, b, c = (np.empty((rows, self.h), np.float32) for _ in range(3))
        h = np.zeros((rows, self.h), np.float32)
        ahead = np.empty((steps, rows, len(self.c)), np.float32)
        for t in range(steps):
            self._step(x[t], h, self.dirs[0], a, b, c)
            np.matmul(h, self.wf, out=ahead[t])
        h[:] = 0
        out = np.zeros((rows, len(self.c)), np.float32)
        for t in reversed(range(steps)):
            self._step(x[t], h, self.dirs[1], a, b, c)
            logit = ahead[t]
            logit += h @ self.wb
            logit += self.c
            np.exp(np.minimum(logit, 60, out=logit), out=logit)
            logit *= ((x[t] < 256) / logit.sum(1))[:, None].astype(np.float32)
            out += logit
        return out


def to_windows(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows, window) of bytes padded with 256 and the text each window belongs to."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = -(-sizes // window)
    out = np.full((int(n.sum()), window), 256, np.int16)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    first = (np.cumsum(n) - n) * window
    out.reshape(-1)[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    return out, np.repeat(np.arange(len(texts)), n)


def _label(shared, window: int):
    def run(batches):
        p, langs, hidden = shared.value
        net = Labeller(p, hidden) if langs else None
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            sums = np.zeros((len(texts), max(1, len(langs))))

            def flush(held, sums=sums):
                x, own = to_windows([t for _, t in held], window)
                own = np.array([i for i, _ in held])[own]
                for a in range(0, len(x), ROWS):
                    np.add.at(sums, own[a : a + ROWS], net(np.ascontiguousarray(x[a : a + ROWS].T)))

            held, size = [], 0
            for i, t in enumerate(texts):
                if not t or not net:
                    continue
                for a in range(0, len(t), 1 << 20):
                    held.append((i, t[a : a + (1 << 20)]))
                    size += len(held[-1][1])
                    if size >= ROWS * window * 8:
                        flush(held)
                        held, size = [], 0
            if held:
                flush(held)
            total = sums.sum(1)
            prob = sums / np.maximum(total, 1e-9)[:, None]
            best = prob.argmax(1)
            known = (total > 0) & np.array(b.column(2).to_pylist(), bool)
            pred = [langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)] if langs else [UNKNOWN] * len(texts)
            score = np.where(known, prob[np.arange(len(texts)), best], 0.0) if langs else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], names=["id", "lang_pred", "score"])

    return run


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, spots: int = SPOTS, window: int = WINDOW) -> tuple:
    """(weights, languages, hidden).  Without any row to learn from there are no languages and all texts are ``und``."""
    known = docs.filter(learn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null").filter(F.rlike("text", F.lit(LETTER)))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    n = F.greatest(F.lit(1), F.length("text") - window)
    at = F.transform(F.sequence(F.lit(0), F.lit(spots - 1)), lambda i: F.substring(F.col("text"), (n * i / spots).cast("int") + 1, F.lit(window)))
    rows = known.select("id", "lang", at.alias("cuts")).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= sample).select("id", "lang", "cuts").collect()
    rows.sort(key=lambda r: (r["lang"], r["id"] if r["id"] is not None else -1))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return {}, [], HIDDEN
    cuts = [(c.encode()[:window], langs.index(r["lang"])) for r in rows for c in r["cuts"] if c]
    x, own = to_windows([c for c, _ in cuts], window)
    return train(x, np.array([k for _, k in cuts])[own], len(langs)), langs, HIDDEN


def identify(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, lang_pred and score for every row; ``und`` with score 0 where the text is null or has no letter.

    Repeated rows each get their row, an empty table gives an empty result, and a text of any length is read in pieces of a megabyte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.rlike(F.col(text_col), F.lit(LETTER)), F.lit(False)).alias("letters"))
    return src.mapInArrow(_label(shared, window), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def _accepted(shared, window: int, at: int, least: float):
    """The rows whose text has a letter and one language with a probability of at least ``least``; the last column says whether there is a letter."""
    label = _label(shared, window)

    def run(batches):
        release()
        for b in batches:
            asked = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column(at), b.column(b.num_columns - 1)], names=["id", "text", "letters"])
            (got,) = label([asked])
            sure = pc.and_(pc.not_equal(got.column(1), UNKNOWN), pc.greater_equal(got.column(2), least)) if shared.value[1] else b.column(b.num_columns - 1)
            yield b.filter(sure).select(list(range(b.num_columns - 1)))

    return run


def drop_rejected(docs: DataFrame, model: tuple, text_col: str = "text", least: float = LEAST, window: int = WINDOW) -> DataFrame:
    """The rows whose text the network gives one language, with all their columns.

    Rows go whose text is null or has no letter, and rows whose pooled probability stays below ``least``: no language then has more than all others.
    Each row is judged by its own text, so null and repeated ids make no difference.  Without languages to learn from, rows with a letter stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    asked = docs.withColumn(fresh(docs, "letters"), F.coalesce(F.rlike(F.col(text_col), F.lit(LETTER)), F.lit(False)))
    return asked.mapInArrow(thrifty(_accepted(shared, window, docs.columns.index(text_col), least)), docs.schema)
