"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer reads words and writes classes: insult and threat stems with
weights, targets, negations, verbs of reported speech, other words. Three small
transducers follow negation, reported speech and targets; their composition walks each
clause and says, for every insult or threat, in which pattern it stands. What counts is
the matched clauses' weights by pattern, never a word by itself; a logistic layer
turns them into a probability.

The lexicon has fixed public words; stems are learned beside them from labelled rows,
as prefixes that labelled texts use far more often when toxic.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored

# Words of the classes, in English, German, French and Spanish.
INSULTS = ("idiot moron stupid scum trash loser pathetic worthless disgusting clown dumb jerk imbecile filth vermin "
           "dummkopf trottel abschaum arschloch imbécile connard ordure estúpido imbécil basura").split()
THREATS = "kill murder strangle stab shoot töten umbringen tuer frapper matar golpear".split()
TARGETS = ("you your yours he him she her they them these those people everyone du dich dir ihr euch sie tu te toi vous ils elles "
           "tú ti usted ustedes ellos ellas").split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't nicht kein keine nie pas jamais nunca tampoco".split()
REPORTS = ("said says told wrote called quoted claimed alleged reported according sagte schrieb nannte laut dit écrit selon "
           "dijo escribió llamó según").split()

PREFIXES = range(4, 13)
PATTERNS = ("plain", "negated", "reported")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")
N_FEATURES = 2 * 2 * len(PATTERNS) + 3


def _compose() -> dict:
    """The product of the three context transducers: (state, class) -> (state, pattern).
    A state is (words for which a negation still holds, reported, target seen)."""
    moves = {}
    for neg in range(4):
        for rep in (0, 1):
            for target in (0, 1):
                for kind in "ITYNRO":
                    after = 3 if kind == "N" else max(neg - 1, 0)
                    pattern = None
                    if kind in "IT":
                        pattern = 1 if neg else 2 if rep else 0
                    moves[(neg, rep, target), kind] = ((after, rep or int(kind == "R"), target or int(kind == "Y")), pattern)
    return moves


MOVES = _compose()
START = (0, 0, 0)


@dataclass
class ToxicityModel:
    """Stems with weights, and the logistic layer over clause features."""

    insults: dict[str, float]
    threats: dict[str, float]
    weights: list[float] = field(default_factory=list)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for stems, kind in ((self.insults, "I"), (self.threats, "T")):
            for stem, weight in stems.items():
                found.add_word(stem, (len(stem), kind, weight))
        found.make_automaton()
        return found

    def score(self, text: Column) -> Column:
        """Probability that a text is toxic; null counts as an empty text."""
        model = self

        @F.pandas_udf("double")
        def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            stems = model.automaton() if model.insults or model.threats else None
            w = np.array(model.weights)
            for part in parts:
                x = np.array([clause_features(t, stems) for t in part]).reshape(-1, N_FEATURES)
                yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30))))

        return toxicity(text.cast("string"))


def _stem_hits(low: str, stems) -> dict[int, tuple[str, float]]:
    """Start of each word that begins with a stem -> class and weight of the heaviest."""
    hits: dict[int, tuple[str, float]] = {}
    for end, (length, kind, weight) in stems.iter(low):
        at = end - length + 1
        if (at == 0 or not (low[at - 1].isalnum() or low[at - 1] == "_")) and weight > hits.get(at, ("", -1.0))[1]:
            hits[at] = (kind, weight)
    return hits


def clause_features(text: str | None, stems) -> list[float]:
    """Sums over matched clauses by (insult or threat, pattern, target in the clause), and
    the number of matched clauses, the heaviest clause and the length of the whole text."""
    out = [0.0] * N_FEATURES
    if not text:
        return out
    out[-1] = math.log1p(len(text)) / 10
    low = text.lower()
    hits = _stem_hits(low, stems) if stems is not None else {}
    cuts = [m.end() for m in _CLAUSE.finditer(low)] if hits else []
    done = -1
    for at in sorted(hits):
        if at < done:
            continue
        k = bisect_right(cuts, at)
        begin, done = cuts[k - 1] if k else 0, cuts[k] if k < len(cuts) else len(low)
        state, found, total = START, [], 0.0
        for word in _WORD.finditer(low, begin, done):
            kind, weight = hits.get(word.start()) or (_CLASS.get(word.group(), "O"), 0.0)
            state, pattern = MOVES[state, kind]
            if pattern is not None:
                found.append((kind, pattern, weight))
        for kind, pattern, weight in found:
            out[((kind == "T") * 2 + state[2]) * len(PATTERNS) + pattern] += weight
            total += weight * (0.5 if pattern else 1.0)
        out[-3] += bool(found)
        out[-2] = max(out[-2], total)
    for i in range(N_FEATURES - 3):
        out[i] = math.log1p(out[i])
    out[-3] = math.log1p(out[-3])
    out[-2] = math.log1p(out[-2])
    return out


_CLASS = {w: "R" for w in REPORTS} | {w: "N" for w in NEGATIONS} | {w: "Y" for w in TARGETS}


def _count_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            (toxic if label else clean).update({w[:n] for w in words for n in PREFIXES if len(w) >= n})
    keys = list(toxic)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([0] * len(keys), pa.int64())], names=["stem", "a", "b"])
    keys = list(clean)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([0] * len(keys), pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["stem", "a", "b"])


def _learn_stems(sample: DataFrame, n1: int, n0: int) -> dict[str, float]:
    """Shortest prefixes that toxic texts use at least e**3 times as often, where that is not
    chance: the likelihood ratio must pass a bound that grows with the number of prefixes. All
    that pass are kept; the labelled sample bounds them."""
    counts = sample.mapInArrow(_count_prefixes, "stem string, a long, b long").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    p1, p0 = n1 / (n1 + n0), n0 / (n1 + n0)
    log_odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    n = F.col("a") + F.col("b")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(0.0)
    rows = stored(counts.where("a >= 3").withColumn("w", log_odds).withColumn("g", 2 * (part("a", p1) + part("b", p0))).where("w >= 3"), "stems")
    bound = 2 * math.log(max(rows.count(), 2)) + 4
    strong = {r.stem: r.w for r in rows.where(F.col("g") >= bound).collect()}
    return {s: w for s, w in strong.items() if not any(s[:n] in strong for n in range(min(PREFIXES), len(s)))}


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 max_rows: int = 12_000) -> ToxicityModel:
    """Learn stems and the logistic layer from at most ``max_rows`` labelled rows, chosen by
    the hash of their id. Rows without a label or an id are left out; of several labels for
    one id the highest counts. With no labelled rows, or of one class only, the fixed words
    alone score with a fixed layer."""
    rows = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
            .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    # At most max_rows rows of 12 bytes are broadcast; texts are not shuffled.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(rows), "id").select("text", "y")
    n = {r.y: r.c for r in sample.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("c")).collect()}
    insults, threats = dict.fromkeys(INSULTS, 3.0), dict.fromkeys(THREATS, 2.0)
    fixed = [-4.0, *[1.0, 0.5, 0.5, 1.5, 1.0, 1.0], *[0.0, 0.0, 0.0, 1.5, 0.2, 0.2], 2.0, 1.0, 0.0]
    if not (n.get(True) and n.get(False)):
        return ToxicityModel(insults, threats, fixed)
    model = ToxicityModel(insults | _learn_stems(sample, n[True], n[False]), threats)

    def features(batches):
        stems = model.automaton()
        for batch in batches:
            x = [clause_features(t, stems) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    got = sample.mapInArrow(features, "x array<double>, y int").collect()
    model.weights = _logistic(np.array([r.x for r in got]), np.array([r.y > 0 for r in got], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, turns: int = 30) -> list[float]:
    """Newton steps for ridge-penalised logistic regression (intercept first, unpenalised)."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]
