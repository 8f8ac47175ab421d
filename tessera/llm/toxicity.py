"""Toxicity by a weighted finite-state grammar over clauses.

Words are read by a lexicon transducer whose insult entries (whole words and stems) are
learned from labelled texts; threats, targets, negation and reported speech are closed
classes. Transducers for threat, target, negation and reported speech rewrite labels or scale
weights, and are composed once into one machine. The machine reads each sentence with a
match, as one clause in which commas, colons and quotes are pauses: they end a negation, and
reported speech goes on behind them. A text's score comes from the weights of its matched
clauses and from nothing else.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.langid import held_out
from tessera.llm.text_arrow import chunks
from tessera.runtime import read_table, ship_package

#: At most about this many labelled rows (dealt by a hash of the id) teach the grammar.
TRAIN_ROWS = 20_000
STEMS = (3, 4, 5, 6, 7, 8)
#: Most entries of the learned lexicon; the strongest stay.
ENTRIES = 4_000

TARGET = {"you", "your", "yourself", "he", "she", "they", "them", "him", "du", "dich", "dir", "ihr", "euch", "sie", "er",
          "tu", "toi", "te", "vous", "il", "elle", "ils", "usted", "ustedes", "ti", "él", "ella", "ellos"}
THREAT = {"kill", "hurt", "destroy", "beat", "burn", "shoot", "stab", "murder", "töten", "umbringen", "schlagen", "vernichten",
          "tuer", "frapper", "détruire", "brûler", "matar", "golpear", "destruir", "quemar"}
NEGATION = {"not", "no", "never", "isn", "aren", "wasn", "don", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"}
REPORT = {"said", "says", "wrote", "called", "claims", "quoted", "sagte", "schrieb", "nannte", "behauptet", "dit", "écrit",
          "appelé", "dijo", "escribió", "llamó"}
CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|[,:]")

INSULT, THREATS, TARGETS, NEGATE, REPORTS, PAUSE, OTHER = range(7)
LABELS = 7


class Transducer:
    """Deterministic: (state, label) -> (state, label, factor, bonus)."""

    def __init__(self, n_states: int, arcs: dict[tuple[int, int], tuple[int, int, float, float]]):
        self.n = n_states
        self.arcs = {(s, x): arcs.get((s, x), (s, x, 1.0, 0.0)) for s in range(n_states) for x in range(LABELS)}

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: what this one writes, the other reads; factors multiply, boni add."""
        arcs = {}
        for s in range(self.n):
            for t in range(other.n):
                for x in range(LABELS):
                    s2, y, f, b = self.arcs[s, x]
                    t2, z, g, c = other.arcs[t, y]
                    arcs[s * other.n + t, x] = (s2 * other.n + t2, z, f * g, b * g + c)
        return Transducer(self.n * other.n, arcs)

    def score(self, labels: list[int], weights: list[float]) -> float:
        state, total = 0, 0.0
        for x, w in zip(labels, weights):
            state, _, f, b = self.arcs[state, x]
            total += f * w + b
        return max(0.0, total)


def negation(reach: int = 3, factor: float = 0.25) -> Transducer:
    """After a negation, an insult or threat within ``reach`` words weighs less."""
    arcs = {}
    for s in range(reach + 1):
        for x in range(LABELS):
            arcs[s, x] = (max(0, s - 1), x, factor if s and x in (INSULT, THREATS) else 1.0, 0.0)
        arcs[s, NEGATE] = (reach, NEGATE, 1.0, 0.0)
        arcs[s, PAUSE] = (0, PAUSE, 1.0, 0.0)
    return Transducer(reach + 1, arcs)


def reported(factor: float = 0.5) -> Transducer:
    """After a verb of speech, what follows in the clause is somebody else's, pauses or not."""
    arcs = {(0, REPORTS): (1, REPORTS, 1.0, 0.0)}
    arcs |= {(1, x): (1, x, factor if x in (INSULT, THREATS) else 1.0, 0.0) for x in range(LABELS)}
    return Transducer(2, arcs)


def target(bonus: float = 0.5) -> Transducer:
    """An insult in a clause that has named a target counts more."""
    return Transducer(2, {(0, TARGETS): (1, TARGETS, 1.0, 0.0), (1, INSULT): (1, INSULT, 1.0, bonus)})


def threat(bonus: float = 4.0) -> Transducer:
    """A threat verb counts only together with a target, before or after it; the word that makes
    the pair complete is written as a threat."""
    return Transducer(4, {(0, THREATS): (1, THREATS, 0.0, 0.0), (0, TARGETS): (2, TARGETS, 1.0, 0.0),
                          (1, TARGETS): (3, THREATS, 0.0, bonus), (2, THREATS): (3, THREATS, 0.0, bonus)})


GRAMMAR = target().then(threat()).then(reported()).then(negation())


class Lexicon(dict):
    """word -> (label, weight); the longest known stem of a word or the word itself counts,
    whichever weighs most."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems
        self.closed = {w: k for k, ws in ((PAUSE, {",", ":"}), (THREATS, THREAT), (TARGETS, TARGET), (NEGATE, NEGATION), (REPORTS, REPORT)) for w in ws}

    def __missing__(self, word: str):
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if n < len(word):
                best = max(best, self.stems.get(word[:n], 0.0))
        out = (INSULT, best) if best > 0 else (self.closed.get(word, OTHER), 0.0)
        if len(self) < 300_000:
            self[word] = out
        return out


def clause_scores(low: str, lexicon: Lexicon, hits: set) -> list[float]:
    """Scores of the clauses (of a lower-cased text) that hold one of ``hits``."""
    out = []
    for clause in CLAUSE.split(low):
        inside = TOKEN.findall(clause)
        if not hits.isdisjoint(inside):
            read = [lexicon[w] for w in inside]
            out.append(GRAMMAR.score([x for x, _ in read], [w for _, w in read]))
    return out


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Sum, maximum and second of the clause scores, number of clauses that score and their share
    of the words, all but the maximum damped by logarithms."""
    low = (text or "").lower()
    words = WORD.findall(low)
    hits = {w for w in set(words) if lexicon[w][0] in (INSULT, THREATS)}
    scores = sorted((s for s in clause_scores(low, lexicon, hits) if s > 0), reverse=True) if hits else []
    if not scores:
        return [0.0] * 5
    n = len(scores)
    return [math.log1p(sum(scores)), scores[0], math.log1p(n), math.log1p(scores[1] if n > 1 else 0.0), math.log1p(1000 * n / len(words))]


def _sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    total = rows.select(id_col).count()
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("train"), F.col(id_col)), F.lit(1 << 30)) < int(most / total * (1 << 30)))


def learn_lexicon(rows: DataFrame, least: int = 4) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of words and stems from rows (t, y): document counts are added up inside the
    partitions and then by entry; only entries that mark label 1 reach the driver."""

    def count(batches):
        import pyarrow as pa

        seen: dict[str, list[int]] = {}

        def out():
            keys = list(seen)
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([seen[k][j] for k in keys], pa.int64()) for j in (0, 1))], names=["k", "n0", "n1"])
            seen.clear()
            return batch

        for batch in batches:
            for part, texts in chunks(batch, "t"):
                for text, y in zip(texts, part.column("y").to_pylist()):
                    words = set(WORD.findall((text or "").lower()))
                    for k in {"=" + w for w in words} | {w[:n] for w in words for n in STEMS if n < len(w)}:
                        seen.setdefault(k, [0, 0])[y] += 1
                if len(seen) > 400_000:
                    yield out()
        if seen:
            yield out()

    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    t0, t1 = totals.get(0, 0), totals.get(1, 0)
    if not t1:
        return {}, {}
    odds = F.log((F.col("n1") + 0.5) / F.lit(t1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(t0 + 1.0))
    counted = rows.mapInArrow(count, "k string, n0 long, n1 long").groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # an entry must occur with label 1 often enough, and rather there than elsewhere
    strong = counted.where((F.col("n1") >= least) & (F.col("n1") > F.col("n0"))).withColumn("w", odds).where("w > 2.5")
    got = strong.orderBy(F.desc(F.col("w") * F.sqrt("n1")), "k").limit(ENTRIES).collect()
    words = {r["k"][1:]: float(r["w"]) for r in got if r["k"][0] == "="}
    return words, {r["k"]: float(r["w"]) for r in got if r["k"][0] != "="}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.eye(a.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _score(docs: DataFrame, lexicon: tuple, coef: list[float] | None, extra: str = "") -> DataFrame:
    """docs (i, t and, where ``extra`` names it, y) -> i, score, or the features as an array."""
    kind = docs.schema["i"].dataType.simpleString()
    held: dict = {}

    def run(batches):
        import pyarrow as pa

        lex = held.setdefault("x", Lexicon(*lexicon))
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                f = [features(t, lex) for t in texts]
                if coef is None:
                    yield pa.RecordBatch.from_arrays([part.column("i"), part.column("y"), pa.array(f, pa.list_(pa.float64()))], names=["i", "y", "f"])
                else:
                    z = np.column_stack([np.ones(len(f)), np.array(f)]) @ np.array(coef)
                    yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["i", "score"])

    return docs.mapInArrow(run, f"i {kind}, " + ("y int, f array<double>" if coef is None else "score double"))


def score_toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   rows: int = TRAIN_ROWS) -> DataFrame:
    """id and score (0..1) of every whole text; ``labelled`` has id, text and label of the rows
    to learn from.

    At most about ``rows`` of them, dealt by a hash of the id, teach lexicon and calibration.
    A null or empty text scores as one without matches. Without labelled rows of both kinds
    every score is 0 resp. 1 by the labels there are (0 with none). Only id and text are read,
    so other columns may have any names; rows that repeat an id or a text are scored each, and
    an empty table gives none. A text is read whole, however long. Entries of equal strength at
    the end of the lexicon are taken in the order of their letters.
    """
    ship_package(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    teach = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"))
    teach = _sample(teach, "i", rows)
    lexicon = learn_lexicon(teach)
    got = _score(teach, lexicon, None).select("i", "y", "f").collect()
    got.sort(key=lambda r: (r["i"], r["y"], r["f"]))
    y = np.array([r["y"] for r in got], float)
    if len(got) and 0 < y.mean() < 1:
        coef = fit_logistic(np.array([r["f"] for r in got]), y).round(9).tolist()
    else:
        coef = [30.0 if len(got) and y.mean() == 1 else -30.0, 0, 0, 0, 0, 0]
    return _score(picked, lexicon, coef).withColumnRenamed("i", id_col)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """A document with several labels counts as toxic if one of them is."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(F.col("toxic").isin(0, 1) & ~held_out(0, 5)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most about TRAIN_ROWS ids and labels, so they go to the texts and not the texts to them
    learn = docs.join(F.broadcast(_sample(labels, "doc_id", TRAIN_ROWS)), "doc_id")
    out = score_toxicity(docs, learn)
    return out.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
