"""Toxicity: a weighted finite-state pattern grammar over clauses.

Tokens have classes: insult I, threat verb K, target T, negation N, reported speech R. Five weighted machines read a clause:

- negation: after N, up to ``WINDOW`` tokens on, I and K become negated, i and k;
- reported speech: a clause with an R anywhere is worth ``REPORTED_SHARE`` of itself;
- target: an insult or threat of a clause that has a T, before or after it, may become aimed (J, L, and j, l where negated); for a
  T that is still to come the machine guesses, and a guess that no T makes good is worth nothing;
- insult: one I, J, i or j is taken, at ``OPEN`` or full weight, the negated ones at ``NEGATED`` of it;
- threat: one L or l is taken; a threat verb without a target is none.

The machines are composed (each reads what the one before puts out; weights multiply), and a clause is worth its best
accepted path, or nothing. So a clause counts once, however many insults it has, an insult whose target is left out counts less than an
aimed one, and threats need a target. A document's features are its best clause, the sum of its clauses and its number of clauses,
so that long texts are not judged by their length; a logistic fit makes them a probability.

Closed classes (pronouns, negation, speech verbs, threat verbs) are fixed lists; insults and their weights
are learned: words and word stems of 4 to 8 bytes whose document odds differ between labelled toxic and clean
rows. Learning takes about ``SAMPLE`` labelled rows (a documented bound); all documents are scored.
Defined results: a null or empty text has no clause and scores the base rate's fit; with no toxic label
the fixed classes alone count; equal texts with different labels are toxic; each row is scored by itself, repeated rows alike; texts
of any length are read whole; other columns are dropped, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, chunks, documents, held_out, lowered, prefix_sums, range_hashes, staged, tidy
from .labelled import labelled_sample

SAMPLE = 12_000
STEMS = (4, 5, 6, 7, 8)
#: Fixed closed classes of the grammar, in four languages.
TARGET = {"you", "your", "yours", "youre", "u", "he", "she", "they", "them", "tu", "toi", "vous", "du", "dich", "ihr", "sie", "usted", "ustedes", "eres"}
NEGATION = {"not", "cannot", "no", "never", "isnt", "arent", "dont", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "ni"}
REPORTED = {"said", "say", "says", "wrote", "called", "quoted", "claimed", "sagte", "dijo", "escribió", "écrit"}
THREAT = {"kill", "murder", "stab", "strangle", "hurt", "destroy", "töten", "tuer", "matar", "matarte"}
FIXED = {w.encode(): c for words, c in ((TARGET, "T"), (NEGATION, "N"), (REPORTED, "R"), (THREAT, "K")) for w in words}
CLAUSE = re.compile(rb"[.!?;:\n]+")
LETTERS = re.compile(rb"[a-z\x80-\xff]+(?:'t(?![a-z\x80-\xff]))?")
#: Ends of contracted negations, with either apostrophe.
CONTRACTED = (b"n't", b"n\xe2\x80\x99t")
WINDOW = 3
#: What is left of a clause's weight in reported speech, of a negated insult or threat, and of an insult without a target.
REPORTED_SHARE, NEGATED, OPEN = 0.2, 0.1, 0.6
THREAT_WEIGHT = 6.0
#: Tokens whose class a task remembers.
MOST_KNOWN = 200_000


class Machine:
    """Weighted transitions (state, symbol) -> [(state, symbol put out, weight)] and weights of final states. A symbol without
    a transition passes; the state is kept or, where it counts down, one nearer its start."""

    def __init__(self, arcs: dict, final: dict | None = None, fade: dict | None = None):
        self.arcs, self.final, self.fade = arcs, final or {}, fade or {}

    def step(self, state: int, symbol: str) -> list[tuple[int, str, float]]:
        return self.arcs.get((state, symbol)) or [(self.fade.get(state, state), symbol, 1.0)]


class Composed:
    """Machines of which each reads what the one before puts out; weights multiply, and the best path counts."""

    def __init__(self, *parts: Machine):
        self.parts, self.memo = parts, {}

    def step(self, states: tuple[int, ...], symbol: str) -> list[tuple[tuple[int, ...], float, bool]]:
        """Next states, weight, and whether the last machine took the symbol."""
        key = states, symbol
        if key not in self.memo:
            paths = [((), symbol, 1.0)]
            for part, s in zip(self.parts, states):
                paths = [((*now, to), out, w * weight) for now, read, w in paths for to, out, weight in part.step(s, read)]
            self.memo[key] = [(now, w, now[-1] != states[-1]) for now, _, w in paths]
        return self.memo[key]

    def best(self, symbols: list[tuple[str, float]]) -> float:
        """The weight of the best accepted path; a symbol that the last machine takes brings its own weight."""
        found = {(0,) * len(self.parts): 1.0}
        for symbol, own in symbols:
            now: dict[tuple[int, ...], float] = {}
            for states, w in found.items():
                for to, weight, taken in self.step(states, symbol):
                    value = w * weight * (own if taken else 1.0)
                    if value > now.get(to, 0.0):
                        now[to] = value
            found = now
        return max((w * math.prod(p.final.get(s, 1.0) for p, s in zip(self.parts, states)) for states, w in found.items()), default=0.0)


def negation() -> Machine:
    count = range(WINDOW, 0, -1)
    arcs = {(s, "N"): [(WINDOW, "N", 1.0)] for s in range(WINDOW + 1)} | {(s, c): [(s - 1, c.lower(), 1.0)] for s in count for c in "IK"}
    return Machine(arcs, fade={s: s - 1 for s in count})


def reported() -> Machine:
    return Machine({(0, "R"): [(1, "R", 1.0)]}, final={1: REPORTED_SHARE})


def target() -> Machine:
    """State 1 has seen a target, state 2 owes one."""
    aimed = {"I": "J", "K": "L", "i": "j", "k": "l"}
    arcs = {(0, "T"): [(1, "T", 1.0)], (2, "T"): [(1, "T", 1.0)]} | {(1, c): [(1, out, 1.0)] for c, out in aimed.items()}
    arcs |= {(0, c): [(0, c, 1.0), (2, out, 1.0)] for c, out in aimed.items()}
    return Machine(arcs, final={2: 0.0})


def taker(weights: dict[str, float]) -> Machine:
    """Takes one of the symbols; without one, nothing is accepted."""
    return Machine({(0, c): [(0, c, 1.0), (1, c, w)] for c, w in weights.items()}, final={0: 0.0})


def insult() -> Machine:
    return taker({"I": OPEN, "J": 1.0, "i": OPEN * NEGATED, "j": NEGATED})


def threat() -> Machine:
    return taker({"L": 1.0, "l": NEGATED})


def grammar() -> tuple[Composed, Composed]:
    """What finds insults, and what finds threats."""
    return Composed(negation(), reported(), target(), insult()), Composed(negation(), reported(), target(), threat())


def tokens_of(text: bytes) -> list[bytes]:
    return LETTERS.findall(text.lower())


def marks_of(token: bytes, stems=STEMS) -> list[bytes]:
    """A token, without a contracted negation, and its stems, as keys of the lexicon."""
    token = token.partition(b"'")[0]
    return [b"=" + token, *(b"^" + token[:k] for k in stems if len(token) >= k)]


def class_of(token: bytes) -> str:
    """The closed class of a token, - for none."""
    return "N" if token.endswith(CONTRACTED) else FIXED.get(token, "-")


def classes_of(clause: bytes, lexicon: dict[bytes, float], known: dict) -> list[tuple[str, float]]:
    """Class and own weight of each token of a clause that has a class, and - for those that a negation before them passes.
    known holds tokens that were looked up before."""
    out, left = [], 0
    for token in tokens_of(clause):
        got = known.get(token)
        if got is None:
            own = max((lexicon[m] for m in marks_of(token) if m in lexicon), default=0.0)
            if len(known) > MOST_KNOWN:
                known.clear()
            got = known[token] = ("I" if own else class_of(token), own or THREAT_WEIGHT)
        left = WINDOW if got[0] == "N" else left - 1
        if got[0] != "-" or left >= 0:
            out.append(got)
    return out


def clause_score(clause: bytes, lexicon: dict[bytes, float], machines: tuple[Composed, Composed], known: dict) -> float:
    """The weight of the best insult or threat of a clause."""
    symbols = classes_of(clause, lexicon, known)
    kinds = {c for c, _ in symbols}
    return max(machines[0].best(symbols) if "I" in kinds else 0.0, machines[1].best(symbols) if "K" in kinds else 0.0)


def clause_scores(text: bytes, lexicon: dict[bytes, float], machines: tuple[Composed, Composed], known: dict | None = None) -> tuple[float, float]:
    """The best clause's weight and the sum of all."""
    known = {} if known is None else known
    found = [clause_score(clause, lexicon, machines, known) for clause in CLAUSE.split(text)]
    return max(found, default=0.0), sum(found)


def learn_lexicon(sample: DataFrame, smallest: int = 5, most: int = 4000) -> dict[bytes, float]:
    """Words and stems with their log odds; of at most most entries, by evidence (a top-k lexicon)."""

    def count(batches):
        tox, clean, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marks = {m for t in set(tokens_of((text or "").encode())) for m in marks_of(t)}
                (tox if label else clean).update(marks)
                n[bool(label)] += 1
        tox[b""], clean[b""] = n[1], n[0]
        keys = sorted(tox.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([tox[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["mark", "tox", "clean"])

    counts = sample.groupBy("text").agg(F.max("label").alias("label")).mapInArrow(count, "mark binary, tox long, clean long").groupBy("mark").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
    counts = staged(counts, "marks")
    total = counts.where(F.length("mark") == 0)
    t, c = (total.first() or (b"", 0, 0))[1:3]
    if not t or not c:
        return {}
    odds = F.log((F.col("tox") + 0.5) / (F.col("clean") + 0.5) * ((c + 1.0) / (t + 1.0)))
    found = counts.where((F.length("mark") > 0) & (F.col("tox") >= smallest)).withColumn("w", odds).where(F.col("w") > 2.5)
    rows = found.orderBy((F.col("w") * F.col("tox")).desc(), "mark").limit(most).collect()
    return {bytes(r["mark"]): min(float(r["w"]), 8.0) for r in rows}


def hit_documents(off: np.ndarray, data: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which documents have a token or stem of the lexicon, or a threat."""
    exact, bitmap = tables
    data = lowered(data)
    solid = ((data >= 97) & (data <= 122)) | (data >= 128)
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    prev = np.concatenate(([False], solid[:-1]))
    nxt = np.concatenate((solid[1:], [False]))
    starts = np.flatnonzero(solid & (~prev | edge[:-1]))
    ends = np.flatnonzero(solid & (~nxt | edge[1:])) + 1
    sums = prefix_sums(data)
    hit = np.zeros(len(starts), bool)
    for k in (0, *STEMS):
        use = slice(None) if not k else np.flatnonzero(ends - starts >= k)
        s = starts[use]
        h = range_hashes(sums, s, ends[use] if not k else s + k)
        maybe = np.flatnonzero(bitmap[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(exact):
            at = np.minimum(np.searchsorted(exact, h[maybe]), len(exact) - 1)
            good = maybe[exact[at] == h[maybe]]
            hit[good if not k else use[good]] = True
    doc = np.searchsorted(off, starts[hit], "right") - 1
    out = np.zeros(len(off) - 1, bool)
    out[doc] = True
    return out


def lookup_tables(lexicon: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
    keys = [m[1:] for m in lexicon] + [w.encode() for w in THREAT]
    raw = np.frombuffer(b"".join(keys), np.uint8)
    ends = np.cumsum([len(k) for k in keys])
    exact = np.unique(range_hashes(prefix_sums(raw), np.concatenate(([0], ends[:-1])), ends))
    bitmap = np.zeros(1 << 16, bool)
    bitmap[(exact & np.uint64(0xFFFF)).astype(np.int64)] = True
    return exact, bitmap


FEATURES = "best double, total double, clauses long"
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?;:\n"]] = True


def raw_scores(docs: DataFrame, lexicon: dict[bytes, float], keep: list[str]) -> DataFrame:
    """The columns of keep, the best clause's weight, the sum of all and the number of clauses of every row of docs."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", " + FEATURES

    def run(batches):
        machines, tables, known = grammar(), lookup_tables(lexicon), {}
        for batch in batches:
            off, data = buffers(batch.column(0))
            best, total, clauses = np.zeros(len(off) - 1), np.zeros(len(off) - 1), np.zeros(len(off) - 1, np.int64)
            for i, j in chunks(off):
                base = off[i]
                ends = np.concatenate(([0], np.cumsum(ENDS[data[base : off[j]]])))
                clauses[i:j] = np.diff(ends[off[i : j + 1] - base])
                for k in np.flatnonzero(hit_documents(off[i : j + 1] - base, data[base : off[j]], tables)):
                    best[i + k], total[i + k] = clause_scores(data[off[i + k] : off[i + k + 1]].tobytes(), lexicon, machines, known)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(best), pa.array(total), pa.array(clauses)], names=[*keep, "best", "total", "clauses"])

    return docs.select(F.col("text").cast("string"), *keep).mapInArrow(tidy(run), schema)


def fit_line(x: np.ndarray, label: np.ndarray) -> list[float]:
    """Weights of a ridge logistic fit, the last one the constant, by Newton steps."""
    if not len(label) or label.min() == label.max():
        return [1.0, *[0.0] * (x.shape[1] - 1), -3.0]
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), 1e-2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - label) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[dict[bytes, float], list[float]]:
    """Lexicon, and the weights of log1p of best, total and clauses, and of 1."""
    sample = labelled_sample(docs, labels, "toxic", bound)
    lexicon = learn_lexicon(sample)
    own = raw_scores(sample, lexicon, ["label"]).groupBy(F.round("best", 3).alias("best"), F.round("total", 3).alias("total"), "clauses", "label").count().orderBy("best", "total", "clauses", "label").collect()  # of at most bound rows
    n = [r["count"] for r in own]
    x = np.repeat(np.log1p(np.array([[r["best"], r["total"], r["clauses"]] for r in own], float).reshape(-1, 3)), n, axis=0)
    return lexicon, fit_line(x, np.repeat(np.array([r["label"] for r in own], float), n))


def score_toxicity(docs: DataFrame, model: tuple[dict[bytes, float], list[float]], threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row of docs."""
    lexicon, (best, total, clauses, constant) = model
    raw = raw_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lexicon, ["doc_id"])
    line = F.log1p("best") * best + F.log1p("total") * total + F.log1p("clauses") * clauses + constant
    return raw.select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-line))).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict[str, str] = {}
