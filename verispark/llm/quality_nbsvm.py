"""Quality by Naive Bayes support vectors.

Features are indicators of byte n-grams (of two, three and four bytes) in hashed slots.  Each indicator is scaled by the log ratio
of its smoothed counts in the two classes; a linear hinge-loss model on the scaled indicators is fitted by dual coordinate descent.
A logistic curve fitted on rows kept apart turns margins into scores.

The model is fitted on a bounded sample of the labelled rows: for each label the ``SAMPLE`` rows that come first by a hash of the id.
The sample's sorted slot numbers come to the driver (at most 2 * SAMPLE texts of at most SLOTS numbers each); every text of the table
is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.llm.common import Scratch

SAMPLE = 2500
SLOTS = 1 << 17
THRESHOLD = 0.3
PIECE = 1 << 20


class Features:
    """Distinct slots of a text; a long text is taken in pieces that overlap by three bytes."""

    def __init__(self, slots: int):
        self.slots = slots
        self.seen = np.zeros(slots, np.uint8)

    def _hash(self, code: np.ndarray, salt: int) -> np.ndarray:
        return ((code * np.uint32(2654435761) + np.uint32(salt)) >> np.uint32(7)) & np.uint32(self.slots - 1)

    def of(self, text: bytes) -> np.ndarray:
        marked = []
        for a in range(0, max(1, len(text) - 3), PIECE):
            x = np.frombuffer(text, np.uint8, min(len(text) - a, PIECE + 3), a).astype(np.uint32)
            two = x[:-1] | (x[1:] << np.uint32(8))
            three = two[:-1] | (x[2:] << np.uint32(16))
            four = three[:-1] | (x[3:] << np.uint32(24))
            for code, salt in ((two, 0x1111), (three, 0x22222222), (four, 0x5BD1E995)):
                at = self._hash(code, salt)
                self.seen[at] = 1
                marked.append(at)
        out = np.flatnonzero(self.seen.view(bool))
        for at in marked:
            self.seen[at] = 0
        return out


def _ratio(rows: list[np.ndarray], y: np.ndarray, slots: int, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(slots, alpha), np.full(slots, alpha)
    for r, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[r] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: float = 0.1, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights of the hinge-loss model on scaled indicators; the last weight is the bias.  Each row has unit length."""
    rng = np.random.default_rng(seed)
    norms = np.array([np.sqrt((scale[r] ** 2).sum()) + 1e-9 for r in rows])
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    caps = c * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * 10
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = scale[r] / norms[i]
            g = y[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), caps[i])  # |x|^2 + 1 = 2 with the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                bias += step
                alpha[i] = new
    return np.r_[w, bias]


def _logistic(margin: np.ndarray, label: np.ndarray, prior: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1) by Newton steps on smoothed targets."""
    pos, neg = max(1, (label > 0).sum()), max(1, (label <= 0).sum())
    t = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = (p - t) * prior, p * (1 - p) * prior
        g = np.array([(d * margin).sum() + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, learn: Column, sample: int) -> DataFrame:
    """text, label and weight of the ``sample`` rows of each label that come first by a hash of the id; weight undoes the equal share.

    An id with labels that differ is not learned from, and one that repeats counts once; so does each of the documents that share an id.
    The first rows are found by a bound on the hash, drawn from the counts, and then by a top-k of what lies below, so no task sorts a label."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other").filter(learn)
    scratch = Scratch(labels.sparkSession, "labels")
    known = scratch.save(known.withColumn("place", F.shiftrightunsigned(F.xxhash64("id"), 33)), "known")  # 0 to 2 ** 31 - 1
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    picked = None
    for label, n in sorted(sizes.items()):
        below = known.filter(F.col("label") == label)
        bound = min(1 << 31, int((1.5 * sample + 64) / n * (1 << 31)) + 1)
        near = below.filter(F.col("place") < bound)
        if bound < 1 << 31 and near.count() >= sample:
            below = near
        first = below.orderBy("place", "id").limit(sample).select("id", "label", F.lit(n).cast("long").alias("of"))
        picked = first if picked is None else picked.unionByName(first)
    if picked is None:
        picked = known.select("id", "label", F.lit(0).cast("long").alias("of")).limit(0)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")  # 2 * sample rows


def _extract(slots: int):
    def run(batches):
        f = Features(slots)
        for b in batches:
            rows = [f.of(x or b"").astype("<u4").tobytes() for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2), b.column(3)], names=["id", "slots", "label", "of"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, slots: int = SLOTS) -> dict:
    """The model.  Without rows of both labels every score is the share of label 1, or 0.5 where nothing is known."""
    picked = labelled_sample(docs, labels, label_col, id_col, text_col, learn, sample).select("id", "text", "label", "of")
    got = picked.mapInArrow(_extract(slots), "id long, slots binary, label int, of long").collect()
    got.sort(key=lambda r: r["id"])
    rows = [np.frombuffer(bytes(r["slots"]), "<u4").astype(np.int64) for r in got]
    y = np.array([1.0 if r["label"] == 1 else -1.0 for r in got])
    if len(set(y.tolist())) < 2:
        return {"constant": float((y > 0).mean()) if len(y) else 0.5}
    apart = np.arange(len(rows)) % 4 == 3
    if len(set(y[~apart].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        apart = np.zeros(len(rows), bool)
    fit_rows = [r for r, a in zip(rows, apart, strict=True) if not a]
    scale = _ratio(fit_rows, y[~apart], slots)
    w = dual_coordinate_descent(fit_rows, scale, y[~apart])
    held = rows if not apart.any() else [r for r, a in zip(rows, apart, strict=True) if a]
    label = y if not apart.any() else y[apart]
    margin = np.array([_margin(r, scale, w) for r in held])
    of = {r["label"]: r["of"] for r in got}
    share = {1.0: of[1] / max(1, (label > 0).sum()), -1.0: of[0] / max(1, (label < 0).sum())}
    prior = np.array([share[x] for x in label])
    a, b = _logistic(margin, label, prior / prior.mean())
    return {"w": (w[:-1] * scale).astype(np.float32), "norm": (scale**2).astype(np.float32), "bias": float(w[-1]), "a": a, "b": b}


def _margin(r: np.ndarray, scale: np.ndarray, w: np.ndarray) -> float:
    return float((w[:-1][r] * scale[r]).sum() / (np.sqrt((scale[r] ** 2).sum()) + 1e-9) + w[-1])


def _scorer(shared, slots: int):
    def run(batches):
        model = shared.value
        f = Features(slots)
        for b in batches:
            if "constant" in model:
                score = np.full(b.num_rows, model["constant"])
            else:
                w, norm = model["w"], model["norm"]
                score = np.empty(b.num_rows)
                for i, x in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                    r = f.of(x or b"")
                    score[i] = w[r].sum() / (np.sqrt(norm[r].sum()) + 1e-9) + model["bias"]
                score = 1 / (1 + np.exp(-np.clip(model["a"] * score + model["b"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["id", "score"])

    return run


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, threshold: float = THRESHOLD) -> DataFrame:
    """id, score (P(label 1)) and predicted for every row; null texts are empty and are scored too.

    Repeated rows each get their score, an empty table gives an empty result, and a text of any length is read in pieces of a megabyte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one megabyte: two floats a slot
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_scorer(shared, slots), "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
