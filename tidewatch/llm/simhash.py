"""SimHash near-duplicates: fingerprints, an inverted index of their bytes by position, count filtering, exact verification.

Two fingerprints that differ in at most d bits differ in at most d of their eight bytes, so they share at least 8 - d positional
bytes: the guaranteed minimum. The index has a posting list for each choice of that many positions and the bytes there. Two
fingerprints meet in a list exactly if their tally of shared positional bytes reaches the minimum; lists by single bytes would
hold a 256th of all fingerprints each, and tallying over them would visit every 32nd pair of the corpus.

* Equal fingerprints are one class and one posting, so copies never meet. A list cannot have more than 256^d postings.
* In a short list each pair's shared bytes are tallied; it is taken up in the first of the lists it meets in, and its bits
  are compared. In a long list the fingerprints within d bits are looked up instead, which is the same links without pairs.
* Of a list's links a spanning forest is passed on: its components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, held_by_key, stored, text_bytes

#: Shingles whose bits are counted together.
BLOCK = 65_536


@dataclass(frozen=True)
class SimHash:
    words: int = 3  # a shingle
    bits: int = 2  # fingerprints link at this many differing bits or fewer
    seed: int = 42  # of XXH64
    pairwise: int = 64  # postings up to which a list is compared pair by pair

    @property
    def shared(self) -> int:
        """Positional bytes that linked fingerprints are sure to share."""
        return 8 - self.bits


def fingerprint(text: str | None, p: SimHash) -> int:
    """64 bits, each 1 if it is set in over half of the shingles' hashes; 0 without words. A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    words = text_bytes(text).lower().split()
    if not words:
        return 0
    n = min(p.words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:len(ends) - n] + 1))
    joined, seed = b" ".join(words), p.seed
    set_bits, total = np.zeros(64, dtype=np.int64), len(starts)
    for lo in range(0, total, BLOCK):
        hi = min(lo + BLOCK, total)
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[lo:hi].tolist(), ends[lo + n - 1:hi + n - 1].tolist())]
        rows = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > total).tobytes(), "big")


def fingerprints(docs: DataFrame, p: SimHash) -> DataFrame:
    """(doc_id, bits): each row's fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.array([fingerprint(t, p) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").to_numpy(), "bits": found}).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, bits long")


def position_sets(p: SimHash) -> list[tuple[int, ...]]:
    """The choices of byte positions (0: highest byte) that have a list each, in the order of their numbers."""
    return list(combinations(range(8), p.shared))


def byte_mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * (7 - i) for i in positions)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(classes: DataFrame, p: SimHash) -> DataFrame:
    """(choice, key, bits, head) for each class and choice of positions; ``key`` holds the bytes at the chosen positions."""
    keys: list[Column] = [F.struct(F.lit(i).alias("choice"), F.col("bits").bitwiseAND(F.lit(signed(byte_mask(s))).cast("long")).alias("key"))
                          for i, s in enumerate(position_sets(p))]
    return classes.select(F.explode(F.array(*keys)).alias("k"), "bits", "head").select("k.choice", "k.key", "bits", "head")


def list_starts(choice: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each list starts in rows sorted by (choice, key), and the end."""
    if not len(key):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1, [len(key)]))


def tallied_links(choice: np.ndarray, bits: np.ndarray, list_of: np.ndarray, p: SimHash) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of short lists: row numbers of pairs that share enough positional bytes, differ in few enough bits, and meet in no
    list of a smaller number."""
    sets = position_sets(p)
    number = {s: i for i, s in enumerate(sets)}
    # first list of a pair by its tally: bit 7 - i of the index tells that byte i is shared
    first = np.full(256, -1, dtype=np.int64)
    for shared in range(256):
        at = tuple(i for i in range(8) if shared >> (7 - i) & 1)
        if len(at) >= p.shared:
            first[shared] = number[at[:p.shared]]
    for apart in range(1, p.pairwise):
        a = np.flatnonzero(list_of[apart:] == list_of[:-apart])
        if not len(a):
            return
        b = a + apart
        differ = bits[a] ^ bits[b]
        equal = differ.astype(">u8").view(np.uint8).reshape(-1, 8) == 0
        enough = first[np.packbits(equal, axis=1)[:, 0]] == choice[a]
        good = enough & (np.bitwise_count(differ) <= p.bits)
        yield a[good], b[good]


def near_masks(open_positions: tuple[int, ...], bits: int) -> list[int]:
    """Every way to change 1 to ``bits`` bits at the open positions."""
    at = [8 * (7 - i) + j for i in open_positions for j in range(8)]
    return [sum(1 << b for b in chosen) for k in range(1, bits + 1) for chosen in combinations(at, k)]


def looked_up_links(choice: int, bits: np.ndarray, p: SimHash) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one long list, whose fingerprints are sorted: each one's neighbours within the list by binary search."""
    chosen = set(position_sets(p)[choice])
    for mask in near_masks(tuple(i for i in range(8) if i not in chosen), p.bits):
        other = bits ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(bits, other), len(bits) - 1)
        a = np.flatnonzero((bits[at] == other) & (bits < other))
        yield a, at[a]


def forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the first row of its component."""
    label = np.arange(n)
    if not links:
        return label
    a, b = (np.concatenate(x) for x in zip(*links))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def links(classes: DataFrame, p: SimHash) -> DataFrame:
    """(a, b): links between heads of ``classes`` (bits, head) whose components are those of all links."""
    rows = postings(classes, p).repartition("choice", "key").sortWithinPartitions("choice", "key", "bits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # the last list may go on in the next batch; it has 256^bits rows at most
        for b in batches:
            b = b if kept is None else pd.concat([kept, b], ignore_index=True)
            starts = list_starts(b["choice"].to_numpy(), b["key"].to_numpy())
            last = starts[-2] if len(starts) > 1 else 0
            kept = b.iloc[last:]
            yield found(b.iloc[:last])
        if kept is not None:
            yield found(kept)

    def found(b: pd.DataFrame) -> pd.DataFrame:
        choice, bits, head = b["choice"].to_numpy(), b["bits"].to_numpy().view(np.uint64), b["head"].to_numpy()
        starts = list_starts(choice, b["key"].to_numpy())
        sizes = np.diff(starts)
        list_of = np.repeat(np.arange(len(sizes)), sizes)
        short = np.flatnonzero((sizes[list_of] > 1) & (sizes[list_of] <= p.pairwise))
        pairs = [(short[x], short[y]) for x, y in tallied_links(choice[short], bits[short], list_of[short], p)]
        for i in np.flatnonzero(sizes > p.pairwise):
            # rows come sorted as signed numbers
            own = starts[i] + np.argsort(bits[starts[i]:starts[i + 1]], kind="stable")
            pairs += [(own[x], own[y]) for x, y in looked_up_links(int(choice[own[0]]), bits[own], p)]
        root = forest(len(b), pairs)
        below = np.flatnonzero(root != np.arange(len(b)))
        return pd.DataFrame({"a": head[root[below]], "b": head[below]})

    return rows.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, p: SimHash = SimHash()) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text; other columns ignored).

    A null or empty text, or one without words, has fingerprint zero and links like any other. A row without doc_id links
    nothing and has no component (null). Rows that share a doc_id are linked through it.
    """
    prints = stored(fingerprints(docs, p))
    known = prints.where("doc_id IS NOT NULL")
    classes = stored(known.groupBy("bits").agg(F.min("doc_id").alias("head")))
    edges = links(classes, p)
    # an id with several texts links its classes
    several = known.groupBy("doc_id").agg(F.min("bits").alias("one"), F.max("bits").alias("two")).where("one <> two").select("doc_id")
    own = known.join(several, "doc_id", "left_semi").join(classes, "bits").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    named = components(edges.union(own))
    to = stored(classes.join(named, F.col("head") == F.col("node"), "left").select("bits", F.coalesce("component", "head").alias("component")))
    out = held_by_key(prints, to, "bits")
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
