"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Documents over the limit are cut; the remainder comes first, so every later piece is full. Which lengths share a
sequence is decided on the histogram of piece lengths (one count per possible length, whatever the corpus), and the
pieces then find their places by their number among the pieces of their length. No task sees more than a slice of
one length's pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ordinals, stored
from tidewatch.llm.tokens import END_ID, default_path, token_ids

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut_points(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n tokens."""
    if n <= limit:
        return [(0, n)]
    first = n % limit or limit
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


def piece_table(docs: DataFrame, limit: int = 1024, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document of ``docs`` (doc_id, text)."""
    path = path or default_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"], token_ids(b["text"], path, end_id)):
                raw = ids.tobytes()
                for k, (s, n) in enumerate(cut_points(len(ids), limit)):
                    rows.append((doc, k, s, n, zlib.crc32(raw[4 * s:4 * (s + n)])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECES)


def best_two_fit(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in them, how many such sequences), using every piece of ``counts`` once.

    A sequence starts with the longest piece left and takes the longest that fits until none does. If room is left,
    its smallest piece is exchanged for the two unpacked pieces that fill the widened gap best, if they fill it
    better. The same sequence is then taken as often as its pieces last, which uses up one length at least: there are
    no more kinds of sequences than lengths.
    """
    left = np.zeros(limit + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        have, bin_, gap = left.copy(), [], limit
        while True:
            fits = np.flatnonzero(have[1:gap + 1])
            if not len(fits):
                break
            take = int(fits[-1]) + 1
            bin_.append(take)
            have[take] -= 1
            gap -= take
        if gap and len(bin_) > 1:
            small = min(bin_)
            pair = best_pair(have, gap + small)
            if pair and sum(pair) > small:
                bin_.remove(small)
                bin_.extend(pair)
        used = np.bincount(bin_, minlength=limit + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        out.append((tuple(sorted(bin_, reverse=True)), times))
    return out


def best_pair(have: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two available lengths with the largest sum up to ``room``; of equal sums the one with the longest piece."""
    lengths = np.flatnonzero(have[:room + 1])
    lengths = lengths[lengths > 0]
    best, i, j = None, 0, len(lengths) - 1
    while i <= j and j >= 0:
        a, b = int(lengths[j]), int(lengths[i])
        if a + b > room or (i == j and have[a] < 2):
            j -= 1
            continue
        if best is None or a + b > sum(best):
            best = (a, b)
        i += 1
    return best


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first ordinal of each run of places, the sequence it begins in, the offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((taken.get(n, 0), base, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        base += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for n, r in runs.items()}


def pack(pieces: DataFrame, limit: int = 1024) -> DataFrame:
    """Places of the pieces: ``pieces`` with sequence_id and offset. ``pieces`` should be stored.

    Repeated rows and copies are pieces of their own; an empty table packs into no sequence. The driver sees one count
    for each possible length (``limit`` at most) and the plan made of it.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    where = places(best_two_fit(counts, limit))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            lengths, number = b["length"].to_numpy(), b["ordinal"].to_numpy()
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                first, base, off = where[int(n)]
                run = np.searchsorted(first, number[rows], side="right") - 1
                sequence[rows] = base[run] + number[rows] - first[run]
                offset[rows] = off[run]
            yield b.drop(columns="ordinal").assign(sequence_id=sequence, offset=offset)

    numbered = ordinals(pieces, "length", ["doc_id", "piece", "start"])
    return numbered.select(*pieces.columns, "ordinal").mapInPandas(put, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, limit: int = 1024, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents (doc_id, text; further columns are ignored): one row per piece with its place.

    A null or empty text is the end id alone. A row with a null doc_id is packed like any other.
    """
    return pack(stored(piece_table(docs, limit, path, end_id)), limit).withColumn("length", F.col("length").cast("long"))
