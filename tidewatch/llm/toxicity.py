"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

A sentence's score is logistic in its words; a document's is the noisy-or of its sentences, 1 - prod(1 - p). Only
document labels are needed to fit it, and the sentence scores then say where the offence stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = frozenset(".!?\n")
#: Words whose score a worker keeps; beyond it the store starts afresh, which changes no result.
KEPT_WORDS = 1_000_000


def parts(word: str) -> set[str]:
    """A word's features: itself and its runs of 4 and 5 letters, with its ends marked."""
    w = f"<{word}>"
    return {w, *(w[i:i + n] for n in (4, 5) for i in range(len(w) - n + 1))}


def sentences(text: str | None) -> tuple[list[str], np.ndarray]:
    """(words in lower case, number of the sentence of each from 0)."""
    tokens = TOKEN.findall((text or "").lower())
    end = np.fromiter((t in ENDS for t in tokens), bool, len(tokens))
    return [t for t in tokens if t not in ENDS], np.cumsum(end)[~end]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    slope: float  # of the document log-odds, fitted after the noisy-or
    shift: float

    def document(self, log_clean: float) -> float:
        """Score of a document whose sentences are all clean with log-probability ``log_clean``."""
        clean = min(log_clean, -1e-12)
        odds = np.log(-np.expm1(clean)) - clean
        return float(sigmoid(np.array(self.slope * odds + self.shift)))


class Scorer:
    """Scores sentences; keeps the scores of words it has seen."""

    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Probability of each sentence up to the last with words; one without words has that of the bias alone."""
        tokens = TOKEN.findall((text or "").lower())
        known, weights = self.known, self.model.weights
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = np.nan if w in ENDS else sum(weights.get(g, 0.0) for g in sorted(parts(w)))
        z = np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
        end = np.isnan(z)
        sentence = np.cumsum(end)[~end]
        n = int(sentence[-1]) + 1 if len(sentence) else 0
        return sigmoid(np.bincount(sentence, z[~end], n) + self.model.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def log_clean(p: np.ndarray) -> np.ndarray:
    return np.log1p(-np.minimum(p, 1 - 1e-12))


def fit(docs: DataFrame, sample: int = 5000, most_chars: int = 20_000, features: int = 4000, least_docs: int = 5,
        steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> ToxicityModel:
    """Learn from ``docs`` (text, toxic 0/1): about ``sample`` labelled documents, drawn by a hash of the text.

    Longer documents than ``most_chars`` are not drawn (they are scored whole like any other), so the driver holds no
    more than their product. The ``features`` that go most with the label have weights, of those in ``least_docs``
    documents or more. Without labels of both kinds every text gets the share of toxic labels (0.5 without any).
    """
    known = docs.where(F.col("toxic").isNotNull() & F.col("text").isNotNull()).select("text", F.col("toxic").cast("int").alias("toxic")).where(F.length("text") <= most_chars)
    total = known.count()
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(min(1.0, sample / max(total, 1)) * (1 << 20))
    rows = known.where(drawn).toPandas().sort_values(["text", "toxic"], kind="stable")  # the fit does not depend on the order of tasks
    return train(rows["toxic"].to_numpy(np.float64), rows["text"].tolist(), features, least_docs, steps, rate, decay)


def train(y: np.ndarray, texts: list[str], features: int, least_docs: int, steps: int, rate: float, decay: float) -> ToxicityModel:
    """Gradient steps (Adam) on the document likelihood under noisy-or, then a two-parameter fit of its log-odds."""
    share = float(np.mean(y)) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, 0.02), 0.98)
        return ToxicityModel({}, 0.0, 0.0, float(np.log(share / (1 - share))))
    cut = [sentences(t) for t in texts]
    words = sorted({w for ws, _ in cut for w in ws})
    number = {w: i for i, w in enumerate(words)}
    own = [parts(w) for w in words]
    # how many documents of each kind have a feature
    with_: dict[str, list[int]] = {}
    for (ws, _), label in zip(cut, y):
        for g in set().union(*(own[number[w]] for w in set(ws))) if ws else ():
            with_.setdefault(g, [0, 0])[int(label)] += 1
    pos, neg = y.sum(), len(y) - y.sum()
    strength = {g: (b / pos - a / neg) ** 2 / ((a + b + 1) / len(y)) for g, (a, b) in with_.items() if a + b >= least_docs}
    names = sorted(sorted(strength, key=lambda g: (-strength[g], g))[:features])
    column = {g: i for i, g in enumerate(names)}
    pairs = [(i, column[g]) for i, gs in enumerate(own) for g in sorted(gs) if g in column]
    of_word, of_feature = np.array(pairs, np.int64).reshape(-1, 2).T
    live = np.zeros(len(words), bool)
    live[of_word] = True
    token, sentence, doc_of, offset = [], [], [], 0
    for i, (ws, s) in enumerate(cut):
        at = np.fromiter((number[w] for w in ws), np.int64, len(ws))
        n = int(s[-1]) + 1 if len(s) else 1
        token.append(at[live[at]])
        sentence.append(s[live[at]] + offset)
        doc_of.append(np.full(n, i))
        offset += n
    token, sentence, doc_of = np.concatenate(token), np.concatenate(sentence), np.concatenate(doc_of)

    def forward() -> tuple[np.ndarray, np.ndarray]:
        z = np.bincount(of_word, theta[of_feature], len(words))
        p = sigmoid(np.bincount(sentence, z[token], offset) + theta[-1])
        return p, np.minimum(np.bincount(doc_of, log_clean(p), len(y)), -1e-9)

    theta = np.zeros(len(names) + 1)
    theta[-1] = np.log(0.2 * share * len(y) / offset)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        p, clean = forward()
        toxic = -np.expm1(clean)
        pull = np.where(y == 1, -(1 - toxic) / toxic, 1.0)[doc_of] * p / len(y)
        by_word = np.bincount(token, pull[sentence], len(words))
        grad = np.append(np.bincount(of_feature, by_word[of_word], len(names)) + decay * theta[:-1], pull.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-9)
    _, clean = forward()
    odds = np.log(-np.expm1(clean)) - clean
    slope, shift = 1.0, 0.0
    for _ in range(30):  # Newton steps of a logistic fit on one number
        q = sigmoid(slope * odds + shift)
        h = q * (1 - q) + 1e-9
        g0, g1 = (q - y).sum(), ((q - y) * odds).sum() + 1e-3 * (slope - 1)
        a, b, c = h.sum(), (h * odds).sum(), (h * odds * odds).sum() + 1e-3
        det = a * c - b * b
        slope, shift = slope - (a * g1 - b * g0) / det, shift - (c * g0 - b * g1) / det
        slope = min(max(slope, 0.05), 5.0)
    return ToxicityModel(dict(zip(names, theta[:-1].tolist())), float(theta[-1]), float(slope), float(shift))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str | Column]) -> DataFrame:
    """``keep`` columns of ``docs`` and the noisy-or score of each whole text; a null text counts as empty, and an
    empty one, like one without words, gets the score of a single sentence without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        empty = float(log_clean(sigmoid(np.array(model.bias))))
        for b in batches:
            out = []
            for text in b["text"]:
                p = scorer(text)
                out.append(model.document(log_clean(p).sum() if len(p) else empty))
            yield b.drop(columns="text").assign(score=np.array(out, dtype=np.float64))

    picked = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.drop("text").schema)
    return picked.mapInPandas(run, f"{schema}, score double")


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """Sentences whose own score reaches ``threshold``: (doc_id, sentence, start, end, score), code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].astype("Int64"), b["text"]):
                p = scorer(text)
                hits = np.flatnonzero(p >= threshold)
                if len(hits):
                    cuts = [0, *(m.end() for m in re.finditer(r"[.!?\n]", text)), len(text)]
                    rows += [(doc, int(i), cuts[i], cuts[i + 1], float(p[i])) for i in hits]
            yield pd.DataFrame(rows, columns=["doc_id", "sentence", "start", "end", "score"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, sentence int, start int, end int, score double")
