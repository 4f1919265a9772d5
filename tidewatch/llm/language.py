"""Language spans: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty.

A word's scores are log-probabilities of its letter n-grams in each language, capped in range so that one odd word
cannot decide; languages not written in the word's script get the lowest score. The best path through the words of a
text pays a penalty for each change of language, so it labels spans.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import slices
from tidewatch.llm.tokens import Stretches

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
# First and last code point of the scripts told apart.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
NAMES = ["other", *dict.fromkeys(s[0] for s in SCRIPTS)]
STARTS, LASTS = np.array([s[1] for s in SCRIPTS]), np.array([s[2] for s in SCRIPTS])
INDEX = np.array([NAMES.index(s[0]) for s in SCRIPTS])
#: Stretches whose words and scores a worker keeps; beyond it the store starts afresh, which changes no result.
KEPT_WORDS = 200_000
#: Scores that are added up together, so that many new words at once take no more memory than a few.
SCORES_AT_ONCE = 1 << 20


def has_letter(word: str) -> bool:
    return any(c.isalpha() for c in word)


def words_of(text: str) -> list[str]:
    return [w for w in WORD.findall(text) if w.isalpha() or has_letter(w)]


def script(word: str) -> int:
    """Index in NAMES of the script of a word's first letter."""
    point = ord(word[0])
    i = int(np.searchsorted(STARTS, point, side="right")) - 1
    return NAMES.index(SCRIPTS[i][0]) if i >= 0 and point <= SCRIPTS[i][2] else 0


def scripts_of(points: np.ndarray) -> np.ndarray:
    """:func:`script` of words by the code points of their first letters."""
    i = np.searchsorted(STARTS, points, side="right") - 1
    inside = (i >= 0) & (points <= LASTS[i])
    return np.where(inside, INDEX[i], 0)


def grams(word: str, size: int) -> list[int]:
    """Hashed letter n-grams (1 to 3, with word ends) and the word itself."""
    w = f"<{word}>"
    found = [w[i:i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)][2:]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % size for g in [*found, w]]


class Grams(dict):
    """Letter n-gram to its hash, each found once."""

    def __init__(self, size: int):
        self.of = size

    def __missing__(self, gram: str) -> int:
        n = self[gram] = zlib.crc32(gram.encode("utf-8", "surrogatepass")) % self.of
        return n


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # (features, languages)
    written: np.ndarray  # (scripts, languages), true if the language is written in the script
    penalty: float = 6.0
    most: float = 4.0  # range of one word's scores

    def word_scores(self, word: str) -> np.ndarray:
        n = len(self.languages)
        allowed = self.written[script(word)]
        if not n or not allowed.any():
            return np.zeros(n, np.float32)
        s = self.log_p[grams(word, len(self.log_p))].sum(axis=0)
        s = np.maximum(s - s[allowed].max(), -self.most)
        return np.where(allowed, s, -self.most).astype(np.float32)

    def scores_of(self, words: list[str], known: Grams) -> np.ndarray:
        """:func:`word_scores` of every word, a row each; ``known`` keeps the hashes of n-grams."""
        n, size = len(self.languages), len(self.log_p)
        out = np.zeros((len(words), n), np.float32)
        if not n or not words:
            return out
        letters = np.array([max(len(w), 1) for w in words], np.int64)
        for lo, hi in slices((letters * 3 * n).tolist(), SCORES_AT_ONCE):
            flat: list[int] = []
            starts = []
            for word in words[lo:hi]:
                w = f"<{word}>"
                starts.append(len(flat))
                flat += map(known.__getitem__, w[2:])
                flat += map(known.__getitem__, map(str.__add__, w, w[1:]))
                flat += map(known.__getitem__, [w[i:i + 3] for i in range(len(w) - 2)])
                flat.append(zlib.crc32(w.encode("utf-8", "surrogatepass")) % size)
            s = np.add.reduceat(self.log_p[flat], starts, axis=0)
            points = np.array([ord(w[0]) for w in words[lo:hi]])
            allowed = self.written[scripts_of(points)]
            s -= np.where(allowed, s, -np.inf).max(axis=1, keepdims=True)
            s = np.where(allowed, np.maximum(s, -self.most), -self.most)
            out[lo:hi] = np.where(allowed.any(axis=1)[:, None], s, 0)
        return out


def fit(docs: DataFrame, sample_per_language: int = 2000, features: int = 1 << 16, most_languages: int = 200) -> LanguageModel:
    """Learn from ``docs`` (text, lang): n-gram counts of about ``sample_per_language`` whole documents of each language.

    The sample is drawn by a hash of the text, so copies do not raise a language's share of it. Rows with a null lang
    or text are left out; with no row left the model knows no language. More than ``most_languages`` is an error.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1, 0)), np.zeros((len(NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_per_language / sizes[k]))])
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            words: Counter = Counter()
            for text, lang in zip(b["text"], b["lang"]):
                words.update((lang, w.lower()) for w in words_of(text))
            for (lang, w), n in words.items():
                for g in grams(w, features):
                    total[lang, g] += n
                total[lang, -1 - script(w)] += n
        yield pd.DataFrame([(k, g, n) for (k, g), n in total.items()], columns=["lang", "gram", "n"])

    counts = known.where(drawn).mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    table, scripts = np.zeros((features, len(languages))), np.zeros((len(NAMES), len(languages)))
    at = counts["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()
    gram, n = counts["gram"].to_numpy(), counts["n"].to_numpy()
    table[gram[gram >= 0], at[gram >= 0]] = n[gram >= 0]
    scripts[-1 - gram[gram < 0], at[gram < 0]] = n[gram < 0]
    log_p = np.log(table + 0.5) - np.log(table.sum(axis=0) + 0.5 * features)
    written = scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)
    return LanguageModel(languages, log_p, written & (scripts > 0))


def viterbi(scores: np.ndarray, words: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word. ``words`` are rows of ``scores``, text after text; ``sizes`` are words per text.

    Most texts are in one language throughout, which sums of scores show; the others advance together, word by word,
    longest first. Ties stay with the present label, then the smaller.
    """
    labels = np.zeros(len(words), np.uint8)
    one = constant(scores, words, sizes, penalty)
    labels[:] = np.repeat(np.maximum(one, 0), sizes)
    rest = np.flatnonzero(one < 0)
    if len(rest):
        own = np.repeat(one < 0, sizes)
        labels[own] = full_viterbi(scores, words[own], sizes[rest], penalty)
    return labels


def constant(scores: np.ndarray, words: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each text whose best path is shown to have one label, else -1.

    With k the label of the largest total, no stretch of words may gain more than half the penalty by another label: a
    path of m stretches of other labels has m - 1 changes or more, so it gains nothing, and all of one label has no
    larger total.
    """
    texts, n = len(sizes), scores.shape[1]
    of = np.repeat(np.arange(texts), sizes)
    own = scores[words].astype(np.float64)
    total = np.stack([np.bincount(of, own[:, j], texts) for j in range(n)], axis=1)
    best = total.argmax(axis=1)
    own -= own[np.arange(len(words)), best[of]][:, None]
    ends = np.cumsum(sizes)
    sums = np.cumsum(own, axis=0)
    before = np.zeros((texts, n))
    before[sizes > 0] = (sums - own)[(ends - sizes)[sizes > 0]]
    sums -= before[of]
    # falling by a step from text to text, so that a running minimum begins anew in each
    step = 2 * np.abs(sums).max(initial=0.0) + 1
    low = np.minimum.accumulate(np.minimum(sums - own, 0) - (step * of)[:, None], axis=0) + (step * of)[:, None]
    gain = (sums - low).max(axis=1, initial=0.0)
    worst = np.zeros(texts)
    np.maximum.at(worst, of, gain)
    return np.where(worst <= penalty / 2 - 1e-6, best, -1)


def full_viterbi(scores: np.ndarray, words: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes.max()) if len(sizes) else 0
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # texts with more than t words
    n = scores.shape[1]
    came = np.zeros((len(words), n), np.uint8)
    ends = np.zeros(len(sizes), np.int64)
    own = np.arange(n, dtype=np.uint8)
    v = np.zeros((len(sizes), n), np.float32)
    for t in range(longest):
        a = active[t]
        at = starts[:a] + t
        if t:
            now = v[:a]
            top = now.argmax(axis=1)
            best = now[np.arange(a), top][:, None] - penalty
            jump = best > now
            came[at] = np.where(jump, top[:, None].astype(np.uint8), own)
            now = np.where(jump, best, now)
        else:
            now = v[:a]
        now = now + scores[words[at]]
        v[:a] = now - now.max(axis=1, keepdims=True)
    ends = v.argmax(axis=1)
    labels = np.zeros(len(words), np.uint8)
    state = ends.copy()
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        labels[at] = state[:a]
        state[:a] = came[at, state[:a]]
    return labels


class Labeller:
    """Labels the words of batches of texts. What stands between blanks is cut into words once for each worker."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.stretches = Stretches()
        self.index: dict[str, int] = {}
        self.grams = Grams(len(self.model.log_p))
        self.table = np.zeros((0, len(self.model.languages)), np.float32)

    def number(self, word: str) -> int:
        return self.index.setdefault(word, len(self.index))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(label of every word, words per text)."""
        if len(self.stretches) > KEPT_WORDS:
            self.clear()
        parts = [t.split() for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = self.stretches.numbers(chain.from_iterable(parts), int(counts.sum()))
        new, self.stretches.new = self.stretches.new, []
        own = [[self.number(w.lower()) for w in words_of(x)] for x in new]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        self.stretches.fill(self.stretches.numbers(new, len(new)), np.fromiter(chain.from_iterable(own), "<u4", int(sizes.sum())), sizes)
        if len(self.index) > len(self.table):
            fresh = list(islice(self.index, len(self.table), None))  # in the order of their numbers
            self.table = np.concatenate([self.table, self.model.scores_of(fresh, self.grams)])
        words, n = self.stretches.ids(at)
        per_text = np.bincount(np.repeat(np.arange(len(parts)), counts), n, len(parts)).astype(np.int64)
        return viterbi(self.table, words.astype(np.int64), per_text, self.model.penalty), per_text


#: Bytes of text that are labelled together: a long text costs its batch a step a word, so small batches are slower.
AT_ONCE = 8_000_000


def batches_of(texts: list[str | None], most_chars: int = 8_000_000) -> Iterator[tuple[int, list[str]]]:
    texts = ["" if t is None else t for t in texts]
    for lo, hi in slices([len(t) for t in texts], most_chars):
        yield lo, texts[lo:hi]


def predict(docs: DataFrame, model: LanguageModel, keep: list[str | Column], at_once: int = AT_ONCE) -> DataFrame:
    """``keep`` columns of ``docs``, lang_pred and score for each row. If ``keep`` names the text, it is passed through: each
    text goes to Python once and comes back once.

    lang_pred is the language of most words on the best path (ties to the smaller name) and score the share of words
    it labels. A null text, one without letters, or a model without languages gives ``und`` and 0. Whole texts are used.
    """
    languages = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(model)
        for b in batches:
            column = b.column(b.schema.names.index("text"))
            sizes_of = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            rest = [i for i, name in enumerate(b.schema.names) if passed or name != "text"]
            for lo, hi in slices(sizes_of, at_once):  # only a slice of the texts is decoded at a time, and none is encoded again
                texts = ["" if t is None else t for t in column.slice(lo, hi - lo).to_pylist()]
                found, sizes = label(texts) if languages else (np.zeros(0, np.uint8), np.zeros(len(texts), np.int64))
                which, m = np.repeat(np.arange(len(texts)), sizes), max(len(languages), 1)
                n = np.bincount(which * m + found, minlength=len(texts) * m).reshape(len(texts), -1)
                top = n.argmax(axis=1)
                names = [languages[k] if s else UNKNOWN for k, s in zip(top, sizes)]
                kept = [b.column(i).slice(lo, hi - lo) for i in rest]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(names, pa.string()), pa.array(n.max(axis=1) / np.maximum(sizes, 1), pa.float64())],
                    names=[*(b.schema.names[i] for i in rest), "lang_pred", "score"])

    passed = any(isinstance(c, str) and c == "text" for c in keep)
    picked = docs.select(*[c for c in keep if not (isinstance(c, str) and c == "text")], "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if passed or f.name != "text")
    return picked.mapInArrow(run, f"{schema}, lang_pred string, score double")


def spans(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Spans of one language: (doc_id, lang, start, end), code points, from a span's first word to its last.

    Null and letterless texts have no span."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = Labeller(model)
        for b in batches:
            docs_ = list(b["doc_id"].astype("Int64"))
            for lo, texts in batches_of(list(b["text"])):
                found, sizes = label(texts)
                rows, at = [], 0
                for i, (t, n) in enumerate(zip(texts, sizes.tolist())):
                    own = found[at:at + n]
                    at += n
                    p = [m.span() for m in WORD.finditer(t) if has_letter(m[0])]
                    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(p)] if p else []
                    rows += [(docs_[lo + i], model.languages[own[s]], p[s][0], p[e - 1][1]) for s, e in zip(cuts, cuts[1:])]
                yield pd.DataFrame(rows, columns=["doc_id", "lang", "start", "end"]).astype({"doc_id": "Int64"})

    if not model.languages:
        return docs.sparkSession.createDataFrame([], "doc_id long, lang string, start int, end int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang string, start int, end int")
