"""Token ids from a tokenizer file, inside tasks.

The tokenizers library encodes; it is asked once for each distinct stretch of text between single blanks that a worker
meets. A byte-level tokenizer cuts before a blank that stands alone between two other characters, whatever surrounds
them, so the ids of a text are those of its stretches in order. Tokenizers without that cut are used on whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np

#: Appended to every document.
END_ID = 2
#: Characters handed over at once.
BATCH_CHARS = 2_000_000
#: Stretches whose ids a worker keeps, about; more are encoded anew in each batch, which changes no result.
KEPT = 800_000
#: Where a text is cut that has blanks beside other blanks.
ALONE = re.compile(r"(?<=\S) (?=\S)")
LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)(\W.*)?", re.DOTALL)

_LOADED: dict[str, object] = {}
_ENCODERS: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in each worker; special tokens' strings in a text are ordinary text."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.encode_special_tokens = True
        _LOADED[path] = loaded
    return _LOADED[path]


def cuts_at_blanks(path: str) -> bool:
    """Whether the file's tokenizer is byte-level with the usual pattern and changes nothing before it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    one_line = len(tokenizer(path).encode("\n", add_special_tokens=False).ids) == 1
    return one_line and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")


class Stretches(dict):
    """Stretch to number; a new one is numbered when it is looked up. Ids of all stand end to end in one array."""

    def __init__(self):
        self.new: list[str] = []
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def numbers(self, words, n: int) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, n)
        if len(self) > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * len(self)), np.resize(self.size, 2 * len(self))
        return at

    def fill(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of stretches, end to end, and how many each has."""
        used = self.used + len(ids)
        if used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * used)
        self.begin[at], self.size[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used:used] = ids
        self.used = used

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[at] - (ends - size), size)], size

    def shrink(self, n: int, used: int) -> None:
        """Forget all but the first ``n``."""
        while len(self) > n:
            self.popitem()
        self.used = used


class Encoder:
    """Ids of texts by way of the stretches a worker has met; the first KEPT of them stay."""

    def __init__(self, path: str):
        self.encode = tokenizer(path).encode_batch_fast
        self.line = tokenizer(path).encode("\n", add_special_tokens=False).ids[0]
        self.after, self.first = Stretches(), Stretches()  # a blank, or the beginning of a text or of a rest, before them

    def learn(self, index: Stretches, words: list[str], lead: str) -> None:
        found = [e.ids for e in self.encode([lead + w for w in words], add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        index.fill(index.numbers(words, len(words)), np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes)

    def learn_first(self) -> None:
        new, self.first.new = self.first.new, []
        self.learn(self.first, new, "")

    def learn_after(self) -> None:
        """A stretch of letters and a rest that begins with none is cut between them; the letters of many stretches are
        encoded in one go, one to a line."""
        new, self.after.new = self.after.new, []
        cut = [(w, m[1], m[2] or "") for w in new if (m := LETTERS.fullmatch(w))]
        fresh = set(new)
        letters = [c for c in {c for _, c, _ in cut} if c in fresh or c not in self.after]
        if letters:
            ids = np.array(self.encode([" " + "\n ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            line = ids == self.line
            sizes = np.diff(np.append(np.flatnonzero(line), len(ids)), prepend=-1) - 1
            self.after.fill(self.after.numbers(letters, len(letters)), ids[~line], sizes)
        self.after.new = []
        joined = [x for x in cut if x[2]]
        if joined:
            rest = self.first.numbers((r for _, _, r in joined), len(joined))
            self.learn_first()
            core, head = self.after.ids(self.after.numbers((c for _, c, _ in joined), len(joined)))
            tail, back = self.first.ids(rest)
            size = head + back
            is_head = np.repeat(np.tile([True, False], len(joined)), np.stack([head, back], axis=1).reshape(-1))
            ids = np.empty(int(size.sum()), "<u4")
            ids[is_head], ids[~is_head] = core, tail
            self.after.fill(self.after.numbers((w for w, _, _ in joined), len(joined)), ids, size)
        if len(cut) < len(new):
            known = {w for w, _, _ in cut}
            self.learn(self.after, [w for w in new if w not in known], " ")

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids per text)."""
        before = [(x, len(x), x.used) for x in (self.after, self.first)]
        parts = [t.split(" ") for t in texts]
        at, counts, starts = self.numbered(parts)
        uneven = {w for w in self.after.new if not w or w[0].isspace() or w[-1].isspace()} | UNEVEN.intersection(self.after)
        if uneven:  # blanks beside blanks
            UNEVEN.update(uneven)
            parts = [p if uneven.isdisjoint(p) else ALONE.split(t) for p, t in zip(parts, texts)]
            at, counts, starts = self.numbered(parts)
        self.learn_after()
        first = self.first.numbers((p[0] for p in parts), len(parts))
        self.learn_first()
        # the first stretch of a text has no blank before it
        inner = np.ones(len(at), bool)
        inner[starts] = False
        ids_in, size_in = self.after.ids(at[inner])
        ids_first, size_first = self.first.ids(first)
        size = np.empty(len(at), np.int64)
        size[inner], size[~inner] = size_in, size_first
        is_in = np.repeat(inner, size)
        ids = np.empty(len(is_in), "<u4")
        ids[is_in], ids[~is_in] = ids_in, ids_first
        for index, n, used in before:
            if n > KEPT:
                index.shrink(n, used)
        return ids, np.add.reduceat(size, starts) if len(starts) else size

    def numbered(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return self.after.numbers(chain.from_iterable(parts), int(counts.sum())), counts, np.cumsum(counts) - counts


#: Stretches met so far that begin or end with a blank other than the one between stretches, or are empty.
UNEVEN: set[str] = set()


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_ids(texts: Sequence[str | None], path: str, end_id: int = END_ID) -> Iterator[np.ndarray]:
    """The ids of each whole text and the end id, as unsigned 32-bit little-endian arrays; a null text is empty."""
    from tidewatch.llm.common import slices

    texts = ["" if t is None else t for t in texts]
    end = np.array([end_id], "<u4")
    by_stretch = cuts_at_blanks(path)
    for lo, hi in slices([len(t) for t in texts], BATCH_CHARS):
        if by_stretch:
            ids, sizes = encoder(path)(texts[lo:hi])
            upto = np.cumsum(sizes)
            for e, n in zip(upto.tolist(), sizes.tolist()):
                yield np.concatenate([ids[e - n:e], end])
        else:
            for e in tokenizer(path).encode_batch_fast(texts[lo:hi], add_special_tokens=False):
                yield np.array([*e.ids, end_id], dtype="<u4")
