"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols by a lexicon.  Four small transducers read the symbols of a clause:

* negation: for a few words after a negation it is on;
* reported speech: after a verb of saying or a quotation mark it is on until the clause ends;
* target: for a few words around a second or third person or a name it is on;
* attack: an insult, or a threat, gives an event.

They are composed into one automaton whose state is the product of theirs and whose output is the event with the three conditions. A
document's features are the counts of its clauses by their strongest event, and a logistic model fitted on labelled rows weighs them.
Words are never scored on their own: an event counts once for its clause, with what stands around it.

The lexicon has fixed seeds and the terms learned from the labelled sample: words, or beginnings of words, that keep to the texts with
label 1.  A learned term is a threat if a target follows it more often than it goes before, as in "will V you", and an insult otherwise, as in
"you are N".  Targets, negations and verbs of saying are closed classes of words that clean texts have as well, so a label says nothing about them and
they stay as seeds.  The model is fitted on a bounded sample: for each label the ``SAMPLE`` rows that come first by a hash of the id.
Term counts are aggregated on the executors; the driver gets the terms that pass.  Each is in a ``SHARE`` of the sample's texts of label 1, so their number
is bounded by the words of those texts.

A clause is read to its real ends, however far they are: the automaton's state is bounded, and each clause is read once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.llm.quality_nbsvm import labelled_sample

SAMPLE = 4000
SUPPORT = 5
SHARE = 0.01
PRECISION = 0.93
THRESHOLD = 0.5
WORD = r"[^\W\d_]+"

#: Seed words of each symbol, in English, German, French and Spanish.
SEEDS = {
    "insult": "idiot idiots moron morons stupid worthless pathetic loser losers scum trash clown disgusting imbecile dumb idiota idiote dumm abschaum ordure basura",
    "threat": "kill killing destroy hurt murder beat crush burn töten umbringen zerstören tuer détruire matar destruir",
    "target": "you your yours he him she her they them their du dich dir ihr euch sie tu te toi vous il elle ils tú usted ustedes ellos",
    "negation": "not no never none nobody neither nor without nicht kein keine nie ne pas jamais aucun sin nunca ningún",
    "report": "said says say wrote writes called calls claimed quote quoted sagte schrieb nannte dit écrit dijo escribió llamó",
}
SYMBOLS = ["other", "insult", "threat", "target", "negation", "report", "quote"]
EVENTS = ["insult", "threat"]
NEAR, NEGATED = 4, 3
CLAUSE = re.compile(r"[.!?;:\n]+")


def _countdown(trigger: str, n: int):
    """States 0 to n; the trigger sets n, other symbols count down.  On while above 0."""
    return n + 1, lambda s, x: n if x == trigger else max(0, s - 1)


def _latch(triggers: set[str]):
    return 2, lambda s, x: 1 if x in triggers else s


def compose() -> tuple[np.ndarray, np.ndarray, int]:
    """Product automaton: next state and output by [state, symbol].  Output 0 is nothing, else 1 + event * 8 + negated * 4 + reported * 2 + targeted."""
    parts = [_countdown("negation", NEGATED), _latch({"report", "quote"}), _countdown("target", NEAR)]
    states = list(product(*[range(n) for n, _ in parts]))
    number = {s: i for i, s in enumerate(states)}
    step = np.zeros((len(states), len(SYMBOLS)), np.int32)
    out = np.zeros((len(states), len(SYMBOLS)), np.int32)
    for s in states:
        for k, x in enumerate(SYMBOLS):
            step[number[s], k] = number[tuple(f(v, x) for (_, f), v in zip(parts, s, strict=True))]
            if x in EVENTS:
                out[number[s], k] = 1 + EVENTS.index(x) * 8 + (s[0] > 0) * 4 + s[1] * 2 + (s[2] > 0)
    return step, out, number[(0,) * len(parts)]


#: Clauses by event and conditions; then matched clauses, events, events a length, and whether there are two or more.
N_FEATURES = 8 * len(EVENTS) + 4


class Grammar:
    """Features of whole texts for a lexicon of words and beginnings."""

    def __init__(self, words: dict[str, str], stems: dict[str, str]):
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems})
        self.heads = ahocorasick.Automaton()
        for table, stem in ((words, False), (stems, True)):
            for w, s in table.items():
                if s in EVENTS:
                    self.heads.add_word(w, (len(w), stem))
        self.heads.make_automaton()
        self.step, self.out, self.begin = compose()
        self.symbol = {s: i for i, s in enumerate(SYMBOLS)}
        self.token = re.compile(WORD + r"|[\"“”«»„]")

    def _symbol(self, w: str) -> int:
        s = self.words.get(w)
        if s is None:
            s = "quote" if w in '"“”«»„' else next((self.stems[w[:n]] for n in self.lengths if w[:n] in self.stems), "other")
        return self.symbol[s]

    def clause(self, text: str) -> tuple[int, int]:
        """The strongest event of a clause, read forwards and, for what follows an attack, backwards; and its number of events."""
        xs = [self._symbol(w) for w in self.token.findall(text)]
        events = []
        state = self.begin
        for x in xs:
            events.append(int(self.out[state, x]))
            state = int(self.step[state, x])
        state = self.begin
        for i in range(len(xs) - 1, -1, -1):  # a target may stand after the attack
            if events[i] and self.out[state, xs[i]] and (int(self.out[state, xs[i]]) - 1) % 2:
                events[i] = events[i] - 1 | 1
                events[i] += 1
            state = int(self.step[state, xs[i]])
        events = [e for e in events if e]
        return max(events, key=lambda e: (-((e - 1) & 6), (e - 1) & 1, e), default=0), len(events)

    def _attacks(self, low: str):
        """(start, end) of the words, or beginnings of words, that may give an event."""
        for last, (n, stem) in self.heads.iter(low):
            a, z = last - n + 1, last + 1
            if (a == 0 or not low[a - 1].isalnum()) and (stem or z == len(low) or not low[z].isalnum()):
                yield a, z

    def matched(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, event, number of events) of the clauses that hold an event, in the lower-cased text."""
        found, done = [], -1
        low = text.lower()
        attacks = list(self._attacks(low)) if len(self.heads) else []
        stops = [x.span() for x in CLAUSE.finditer(low)] if attacks else []
        opened, closed = [z for _, z in stops], [a for a, _ in stops]
        for start, end in attacks:
            if start < done:
                continue
            i = bisect_right(opened, start)
            a = opened[i - 1] if i else 0
            j = bisect_left(closed, end)
            done = closed[j] if j < len(closed) else len(low)
            e, k = self.clause(low[a:done])
            if e:
                found.append((a, done, e, k))
        return found

    def features(self, text: str) -> np.ndarray:
        f = np.zeros(N_FEATURES, np.float32)
        clauses = self.matched(text)
        for _, _, e, _ in clauses:
            f[e - 1] += 1
        k = sum(c[3] for c in clauses)
        f[: 8 * len(EVENTS)] = np.log1p(f[: 8 * len(EVENTS)])
        f[-4:] = np.log1p(len(clauses)), np.log1p(k), np.log1p(k / (1 + len(text) / 1000)), k >= 2
        return f


def _featuriser(lexicon):
    def run(batches):
        g = Grammar(*lexicon)
        for b in batches:
            rows = [g.features(t.as_py() or "").astype("<f4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2), b.column(3)], names=["id", "f", "label", "of"])

    return run


def _sides(words: set[str], stems: set[str]):
    """For each learned term how often a target follows it within ``NEAR`` words, and how often one goes before."""
    targets = set(SEEDS["target"].split())
    lengths = sorted({len(x) for x in stems})
    token = re.compile(WORD)

    def run(batches):
        counts: dict[tuple[bool, str], list[int]] = {}
        for b in batches:
            for t in b.column(0):
                for clause in CLAUSE.split((t.as_py() or "").lower()):
                    xs = token.findall(clause)
                    near = [i for i, w in enumerate(xs) if w in targets]
                    if not near:
                        continue
                    for i, w in enumerate(xs):
                        keys = [(False, w)] * (w in words) + [(True, w[:n]) for n in lengths if w[:n] in stems][:1]
                        if keys:
                            k, j = bisect_right(near, i), bisect_left(near, i)
                            after = k < len(near) and near[k] - i <= NEAR
                            before = j > 0 and i - near[j - 1] <= NEAR
                            for key in keys:
                                own = counts.setdefault(key, [0, 0])
                                own[0] += after
                                own[1] += before
        rows = [(s, x, a, z) for (s, x), (a, z) in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.int64(), pa.int64()))], names=["stem", "term", "after", "before"])

    return run


def learn_lexicon(sample: DataFrame, support: int = SUPPORT, share: float = SHARE, precision: float = PRECISION) -> tuple[dict[str, str], dict[str, str]]:
    """Words and beginnings of four to six letters that keep to label 1, in ``support`` or a ``share`` of its texts at least, each with its
    role.  sample: id, text, label, of.  Copies of a text count once."""
    sample = sample.dropDuplicates(["label", "text"])
    base = {w: s for s, ws in SEEDS.items() for w in ws.split()}
    support = max(support, int(share * sample.filter("label = 1").count()))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    seen = sample.select("label", F.explode(words).alias("word"))
    heads = sample.select("label", words.alias("ws"))
    cut = F.array_distinct(F.flatten(F.transform("ws", lambda w: F.transform(F.filter(F.array(F.lit(4), F.lit(5), F.lit(6)), lambda n: n < F.length(w)), lambda n: F.substring(w, F.lit(1), n)))))
    both = seen.select("label", F.lit(False).alias("stem"), F.col("word").alias("term")).unionByName(heads.select("label", F.lit(True).alias("stem"), F.explode(cut).alias("term")))
    counts = both.groupBy("stem", "term").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).filter((F.col("pos") >= support) & (F.col("pos") / F.col("n") >= precision))
    got = sorted(counts.collect(), key=lambda r: (len(r["term"]), r["term"]))
    stems: list[str] = []
    for r in got:
        if r["stem"] and r["pos"] >= 2 * support and not any(r["term"].startswith(s) for s in stems):
            stems.append(r["term"])
    learned = {r["term"] for r in got if not r["stem"] and r["term"] not in base}
    sides = sample.filter("label = 1").select("text").mapInArrow(_sides(learned, set(stems)), "stem boolean, term string, after long, before long")
    threat = {(r["stem"], r["term"]) for r in sides.groupBy("stem", "term").agg(F.sum("after").alias("after"), F.sum("before").alias("before")).filter("after > before").collect()}
    role = lambda stem, w: "threat" if (stem, w) in threat else "insult"
    return base | {w: role(False, w) for w in sorted(learned)}, {w: role(True, w) for w in stems}


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """Lexicon and weights.  Without rows of both labels every document gets the score of the seeds' grammar with weights of one."""
    picked = labelled_sample(docs, labels, label_col, id_col, text_col, learn, sample).select("id", "text", "label", "of")
    lexicon = learn_lexicon(picked)
    got = picked.mapInArrow(_featuriser(lexicon), "id long, f binary, label int, of long").collect()
    y = np.array([float(r["label"]) for r in got])
    if len(set(y.tolist())) < 2:
        w = np.r_[np.full(8 * len(EVENTS), 1.0), 1.0, 0.0, 0.0, 1.0, -3.0]
        return {"lexicon": lexicon, "w": w}
    x = np.array([np.frombuffer(bytes(r["f"]), "<f4") for r in got], float)
    of = {r["label"]: r["of"] for r in got}
    share = np.where(y > 0, of[1] / y.sum(), of[0] / (1 - y).sum())
    return {"lexicon": lexicon, "w": _fit_logistic(x, y, share / share.mean())}


def _scorer(shared):
    def run(batches):
        model = shared.value
        g = Grammar(*model["lexicon"])
        for b in batches:
            x = np.zeros((b.num_rows, N_FEATURES + 1))
            x[:, -1] = 1
            clauses = np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column(1)):
                f = g.features(t.as_py() or "")
                x[i, :-1] = f
                clauses[i] = round(float(np.expm1(f[-4])))
            score = 1 / (1 + np.exp(-np.clip(x @ model["w"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(clauses)], names=["id", "score", "clauses"])

    return run


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score (P(label 1)), predicted and the number of matched clauses for every row; null texts are empty.

    Repeated rows each get their score, and an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon, bounded by the sample
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_scorer(shared), "id long, score double, clauses long")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses")
