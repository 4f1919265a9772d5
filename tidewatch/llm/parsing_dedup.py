"""Removal of repeated passages by prefix-free parsing.

A rolling hash of 32 bytes picks triggers: every 100-byte string is led by the smallest hash in it, so equal strings are
led by triggers at the same place. The strings that one trigger leads, one after the other, make a phrase: from the
first of them to the end of the last, so that a phrase overlaps the next by 99 bytes and each 100-byte string stands in
exactly one. The parse of a document is the list of its phrases, the dictionary the list of distinct ones.

* A phrase met before repeats all its strings: only its first place in the corpus goes on.
* Distinct phrases can share a string only if their triggers' 32 bytes are equal. Those that do are looked up in the
  texts, and the suffixes of the dictionary that are at least 100 bytes long are brought together by their first 100
  bytes, in the corpus order of the phrases' first places: all but the first repeat it.

Only equality of 100 bytes matters, so suffixes are ordered by (hash of 100 bytes, corpus place) rather than by letters.
Phrases travel packed, in buckets by trigger hash whose number follows the corpus; each task first reduces its own
phrases to distinct ones, so a passage that stands in a third of all documents costs one phrase for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.llm.common import mix64, slices, stored, text_bytes

LENGTH = 100  # strings that count as repeated
TRIGGER = 32  # bytes of the rolling hash
#: Bytes of text looked at together; a longer text is looked at in pieces, which does not change the result.
PIECE = 1 << 20
#: Bytes of text whose phrases share a bucket, about.
BUCKET = 16 << 20
BASE = 0x5851F42D4C957F2D  # odd, so that powers have inverses
PACKED = "bucket long, kind int, n long, core binary, class binary, doc binary, place binary, count binary, bytes binary"
FOUND, REPEATED, OPEN = 0, 1, 2  # phrases by trigger; repeated ones and open ones by document
DTYPES = {"core": "<u8", "class": "<u8", "doc": "<i8", "place": "<u4", "count": "u1"}


VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2^64; kept by each worker."""
    if base not in _POWERS or len(_POWERS[base]) <= n:
        _POWERS[base] = np.cumprod(np.append(np.uint64(1), np.full(max(n, PIECE + 4096), base, np.uint64)), dtype=np.uint64)
    return _POWERS[base]


class Rolling:
    """Hashes of the substrings of a byte array: differences of prefix sums of weighted bytes, brought to a common
    weight, so that equal substrings of any arrays have equal hashes."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUES[raw] * powers(BASE, n)[:n], out=self.sums[1:])
        self.weight = powers(pow(BASE, -1, 1 << 64), n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.weight[start])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix64((self.sums[width:] - self.sums[:n]) * self.weight[:n])


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    m, have, n = x, 1, len(x) - width + 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[width - have:width - have + n])


def phrases(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core, class, place, count) of the phrases of a byte array of LENGTH bytes or more: hash of the trigger's bytes,
    hash of the phrase's, start of its first string, number of its strings."""
    roll = Rolling(raw)
    h = roll.all(TRIGGER)
    place = np.arange(len(h), dtype=np.uint64)
    lead = smallest((h & np.uint64(0xFFFFFFFF00000000)) | place, LENGTH - TRIGGER + 1) & np.uint64(0xFFFFFFFF)
    first = np.flatnonzero(np.append(True, lead[1:] != lead[:-1]))
    count = np.diff(np.append(first, len(lead)))
    cls = mix64(roll.of(first, first + count - 1 + LENGTH) + count.astype(np.uint64))
    return h[lead[first].astype(np.int64)], cls, first.astype(np.uint32), count.astype(np.uint8)


def ordered(core: np.ndarray, cls: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (core, class) and corpus place, and whether each phrase in it is the first of its class."""
    at = np.lexsort((place, doc, cls, core))
    new = np.append(True, (core[at][1:] != core[at][:-1]) | (cls[at][1:] != cls[at][:-1])) if len(at) else np.zeros(0, bool)
    return at, new


def packed(kind: int, bucket: np.ndarray, parts: dict[str, np.ndarray], texts: list[bytes] | None = None) -> pd.DataFrame:
    """A row for each bucket with its phrases' fields as byte strings."""
    at = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, bucket[at][1:] != bucket[at][:-1])), len(at)) if len(at) else np.zeros(1, int)
    rows = []
    for lo, hi in zip(cuts, cuts[1:]):
        own = at[lo:hi]
        rows.append([int(bucket[own[0]]), kind, len(own), *[parts[k][own].astype(t).tobytes() if k in parts else b"" for k, t in DTYPES.items()],
                     b"".join(texts[i] for i in own) if texts is not None else b""])
    return pd.DataFrame(rows, columns=["bucket", "kind", "n", *DTYPES, "bytes"])


def unpacked(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """The fields that the rows have, as arrays."""
    whole = {k: np.frombuffer(b"".join(rows[k]), t) for k, t in DTYPES.items()}
    return {k: v for k, v in whole.items() if len(v) == len(whole["doc"])}


def bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    return (mix64(x.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def parsed(docs: DataFrame, buckets: int) -> DataFrame:
    """Phrases of all documents, distinct within each task; those that repeat one of the same task are REPEATED."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[str, list[np.ndarray]] = {k: [] for k in DTYPES}
        held = 0

        def flush() -> Iterator[pd.DataFrame]:
            x = {k: np.concatenate(v) for k, v in got.items()}
            at, new = ordered(x["core"], x["class"], x["doc"], x["place"])
            fresh = {k: v[at[new]] for k, v in x.items()}
            again = {k: x[k][at[~new]] for k in ("doc", "place", "count")}
            yield packed(FOUND, bucket_of(fresh["core"], buckets), fresh)
            yield packed(REPEATED, bucket_of_doc(again["doc"], buckets), again)

        for b in batches:
            for doc, text in zip(b["doc"], b["text"]):
                raw = np.frombuffer(text_bytes(text), np.uint8)
                for lo in range(0, len(raw) - LENGTH + 1, PIECE):
                    core, cls, place, count = phrases(raw[lo:lo + PIECE + LENGTH - 1])
                    for k, v in zip(DTYPES, (core, cls, np.full(len(core), doc, np.int64), place + np.uint32(lo), count)):
                        got[k].append(v)
                    held += len(core)
                if held > 3_000_000:
                    yield from flush()
                    got, held = {k: [] for k in DTYPES}, 0
        if held:
            yield from flush()

    return docs.select("doc", "text").mapInPandas(run, PACKED)


def dictionary(rows: DataFrame, buckets: int) -> DataFrame:
    """By document: phrases that repeat an earlier one (REPEATED), and first ones whose trigger leads another (OPEN)."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        own = unpacked(rows[rows["kind"] == FOUND])
        at, new = ordered(own["core"], own["class"], own["doc"], own["place"])
        x = {k: v[at] for k, v in own.items()}
        again = {k: x[k][~new] for k in ("doc", "place", "count")}
        first = {k: x[k][new] for k in ("core", "doc", "place", "count")}
        same = np.append(False, first["core"][1:] == first["core"][:-1]) if len(first["core"]) else np.zeros(0, bool)
        shared = same | np.append(same[1:], False) if len(same) else same
        open_ = {k: v[shared] for k, v in first.items()}
        return pd.concat([rows[rows["kind"] == REPEATED], packed(REPEATED, bucket_of_doc(again["doc"], buckets), again),
                          packed(OPEN, bucket_of_doc(open_["doc"], buckets), open_)])

    return rows.groupBy("bucket").applyInPandas(run, PACKED)


def looked_up(texts: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """OPEN phrases with their bytes, by trigger."""

    def run(key, docs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        x = unpacked(rows)
        raw = {d: text_bytes(t) for d, t in zip(docs["doc"], docs["text"])}
        ends = x["place"].astype(np.int64) + x["count"] - 1 + LENGTH
        return packed(FOUND, bucket_of(x["core"], buckets), x, [raw[d][p:e] for d, p, e in zip(x["doc"].tolist(), x["place"].tolist(), ends.tolist())])

    return texts.groupBy("bucket").cogroup(known.where(F.col("kind") == OPEN).groupBy("bucket")).applyInPandas(run, PACKED)


def suffixes(rows: DataFrame, buckets: int) -> DataFrame:
    """By document: strings of open phrases that an earlier phrase has too, as runs (REPEATED)."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        x, raw = unpacked(rows), b"".join(rows["bytes"])
        size = x["count"].astype(np.int64) - 1 + LENGTH
        begins = np.cumsum(size) - size
        order = np.argsort(x["core"], kind="stable")
        core = x["core"][order]
        # whole groups of a trigger at a time, so that what is held stays small
        cuts = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
        strings = np.add.reduceat(x["count"][order].astype(np.int64), cuts) if len(cuts) else np.zeros(0, np.int64)
        out = []
        for lo, hi in slices(strings.tolist(), 1_000_000):
            own = order[cuts[lo]:cuts[hi] if hi < len(cuts) else len(order)]
            roll = Rolling(np.frombuffer(b"".join(raw[begins[i]:begins[i] + size[i]] for i in own), np.uint8))
            local = np.cumsum(size[own]) - size[own]
            n = x["count"][own].astype(np.int64)
            of = np.repeat(np.arange(len(own)), n)
            within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = local[of] + within
            h = roll.of(start, start + LENGTH)
            doc, place = x["doc"][own][of], x["place"][own].astype(np.int64)[of] + within
            at, new = ordered(x["core"][own][of], h, doc, place)
            again = np.sort(at[~new])  # phrase after phrase, places rising
            if len(again):
                fresh = np.append(True, (of[again][1:] != of[again][:-1]) | (again[1:] != again[:-1] + 1))
                cut = np.flatnonzero(fresh)
                run_ = {"doc": doc[again][cut], "place": place[again][cut], "count": np.diff(np.append(cut, len(again)))}
                out.append(packed(REPEATED, bucket_of_doc(run_["doc"], buckets), run_))
        return pd.concat(out) if out else packed(REPEATED, np.zeros(0, np.int64), {})

    return rows.groupBy("bucket").applyInPandas(run, PACKED)


def merged(place: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by [place, end)."""
    at = np.lexsort((end, place))
    place, end = place[at], np.maximum.accumulate(end[at])
    cut = np.flatnonzero(np.append(True, place[1:] > end[:-1]))
    return list(zip(place[cut].tolist(), end[np.append(cut[1:], len(place)) - 1].tolist()))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the
    kept bytes and the removed spans (start, end).

    A byte goes if a 100-byte string over it also starts earlier: in a row with a smaller doc_id (null before all, rows
    that share one in the order of their texts) or earlier in the same text. A null text is empty and has no bytes.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stats = base.agg(F.sum(F.octet_length("text")), F.count("doc_id"), F.count_distinct("doc_id"), F.count(F.lit(1))).first()
    buckets = max(4, -(-(stats[0] or 0) // BUCKET))
    if stats[1] == stats[2] == stats[3]:
        texts = base.withColumn("doc", F.col("doc_id"))
    else:  # ids that are null or not unique: number the rows instead
        texts = stored(numbered(base.withColumn("_h", F.xxhash64("text"))))
    texts = texts.withColumn("bucket", doc_bucket(buckets))
    known = stored(dictionary(parsed(texts, buckets), buckets))
    more = suffixes(looked_up(texts, known, buckets), buckets)
    spans = known.where(F.col("kind") == REPEATED).select("bucket", "doc", "place", "count").union(more.select("bucket", "doc", "place", "count"))

    def cut(key, docs_: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        doc, place, count = (np.frombuffer(b"".join(rows[k]), DTYPES[k]) for k in ("doc", "place", "count"))
        at = np.argsort(doc, kind="stable")
        names, lo = np.unique(doc[at], return_index=True)
        where = {d: at[a:b] for d, a, b in zip(names.tolist(), lo, np.append(lo[1:], len(at)))}
        out = []
        for doc_id, d, text in zip(docs_["doc_id"], docs_["doc"], docs_["text"]):
            raw, gone = text_bytes(text), []
            if d in where:
                p = place[where[d]].astype(np.int64)
                gone = merged(p, p + count[where[d]] - 1 + LENGTH)
            kept, last = [], 0
            for s, e in gone:
                kept.append(raw[last:s])
                last = e
            kept = b"".join([*kept, raw[last:]])
            row = (doc_id, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
            out.append((*row, kept, [list(g) for g in gone]) if with_text else row)
        names_ = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if with_text else [])]
        return pd.DataFrame(out, columns=names_).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<array<long>>" if with_text else "")
    return texts.select("bucket", "doc_id", "doc", "text").groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInPandas(cut, schema)


def doc_bucket(n: int) -> Column:
    """Bucket of a document; the same number as :func:`bucket_of_doc`."""
    doc = F.col("doc")
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 7)).bitwiseXOR(F.shiftright(doc, 17)), F.lit(n)).cast("long")


def bucket_of_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return (doc ^ (doc >> 7) ^ (doc >> 17)) % n


def numbered(base: DataFrame) -> DataFrame:
    """Rows numbered in the order of (doc_id, text), by range parts: a part's rows follow the counts of those before it."""
    parts = stored(base.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "text")
                   .select("doc_id", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mono")))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("mono").alias("least"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.join(sizes.withColumn("before", before), "part").select("doc_id", "text", (F.col("mono") - F.col("least") + F.col("before")).alias("doc"))
