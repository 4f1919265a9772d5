"""Licence scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser reads the tags' expressions.

Phrases are looked for in the sequence of words, whatever stands between them. A tag (``SPDX-License-Identifier:``)
is followed by an expression of identifiers joined by AND, OR and WITH, with brackets; each identifier becomes a label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notice phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words of the tag that an expression follows.
TAG = "spdx license identifier"
BREAKS = re.compile(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)")
PART = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
RANK = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> tuple[list[str], bool]:
    """Identifiers of an expression in postfix order (operators left out), and whether all of it was well formed.

    Shunting-yard: WITH binds before AND, AND before OR. Reading stops where the expression does (two operands in a
    row, as in a trailing comment); what was read up to there counts. An identifier after WITH is an exception and is
    labelled ``base with exception``.
    """
    out: list[str] = []
    held: list[str] = []
    expect, sound = True, True

    def apply(op: str) -> None:
        if op == "with" and len(out) >= 2:
            b, a = out.pop(), out.pop()
            out.append(f"{a} with {b}")

    for token in PART.findall(expression):
        if token in RANK:
            if expect:
                sound = False
                break
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[token]:
                apply(held.pop())
            held.append(token)
            expect = True
        elif token == "(":
            if not expect:
                break
            held.append(token)
        elif token == ")":
            if expect or "(" not in held:
                sound = False
                break
            while held[-1] != "(":
                apply(held.pop())
            held.pop()
        elif expect:
            out.append(token)
            expect = False
        else:
            break
    sound = sound and not expect and "(" not in held
    while held:
        if (op := held.pop()) != "(" and not expect:
            apply(op)
    return out, sound


def label_of(identifier: str) -> str:
    """Family label of an identifier, itself if none is known."""
    base = identifier.split(" with ")[0]
    for family in ("gpl", "apache", "cc-by", "mit"):
        if base == family or base.startswith(f"{family}-"):
            return family
    return identifier.replace(",", " ")


def automaton(phrases: dict[str, str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in phrases.items():
        a.add_word(f" {phrase} ", (label, len(phrase) + 1))
    a.add_word(f" {TAG} ", (None, 0))
    a.make_automaton()
    return a


def scan_text(text: str, found) -> tuple:
    """n_words, n_base, first and last place, base labels, all labels, score."""
    low = text.translate(UPPER)
    words = BREAKS.sub(" ", low).strip(" ")
    n_words = words.count(" ") + 1 if words else 0
    padded = f" {words} "
    starts, base, tagged = [], set(), False
    for end, (label, back) in found.iter(padded):
        if label is None:
            tagged = True
            continue
        starts.append(end - back)
        base.add(label)
    first = last = None
    if starts:
        first, last = padded.count(" ", 0, min(starts)), padded.count(" ", 0, max(starts))
    labels, sound = set(base), False
    if tagged:
        for m in TAG_LINE.finditer(low):
            ids, good = parse(m[1])
            labels.update(map(label_of, ids))
            sound = sound or (good and bool(ids))
    score = 1.0 if sound else 1 - 0.5 ** len(starts) if starts else 0.25 * bool(labels)
    return n_words, len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(score)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Labels of each whole text of ``docs`` (doc_id, text); a null text is empty, a null doc_id is carried along.

    score: 1 for a well-formed tag expression, else 1 - 2^-n for n phrase places, 0.25 for a broken tag alone, else 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = automaton(phrases)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for b in batches:
            out = pd.DataFrame([scan_text(t or "", found) for t in b["text"]], columns=names)
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy() if len(b) else np.zeros(0, np.int64))
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
