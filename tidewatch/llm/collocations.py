"""Phrase collocations by dynamic itemset counting.

The documents are dealt into shards which are scanned in a cycle, one shard a step. Lengths are interleaved: words are counted
from the first step on; a longer phrase becomes active at the step after both its subphrases (all but its last word, all but
its first) have reached the threshold in what was counted so far, and is counted for one full cycle from there, so its
count is exact wherever it began. Scanning ends when no phrase can be active any more.

A step needs no list of candidates: an occurrence in the scanned shard counts if both subphrases have reached the threshold and
the later of them did so less than a cycle ago. Workers test that with two Bloom filters of fixed size (reached at all, reached
within the last cycle), so they may count a phrase too often or too early. They agree on that for all places of a phrase, so what
a step counts of it is its whole count in the shard, and the counts of a cycle's steps add up to its count or less.

Texts are cut into words once, and kept as blocks of word numbers. The steps count 64-bit hashes, packed in buckets; two phrases
of one hash can only make it reach the threshold too early. In the end the phrases whose hash reached it are counted once more by
their text, which is what the report rests on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.llm.common import held_by_key, mix64, release, stored

#: Characters that end a piece (the blanks between words are the space and the tab), the scale of a score.
ENDS = b".,;:!?\n\x0b\x0c\r"
SCALE = 2_000_000
#: Bytes of text of a block, and of all blocks that a task has begun.
BLOCK_BYTES = 4_000_000
BEGUN_BYTES = 8_000_000
#: Occurrences that a task adds up at once; words of the corpus for each bucket of hashes, and the least number of buckets.
AT_ONCE = 1 << 21
BUCKET_WORDS = 1 << 22
LEAST_BUCKETS = 256
BLOCKS = "shard int, lang string, n long, ids binary, hashes binary, words binary"
COUNTS = "words int, bucket int, hashes binary, counts binary"
REACHED = f"{COUNTS}, fresh array<long>"
PACKED_PHRASES = "lang string, words int, bucket int, phrases binary, counts binary"
PHRASES = "lang string, words int, phrase string, total long"
KEY = ["lang", "phrase"]


@dataclass(frozen=True)
class Mining:
    longest: int = 4
    least: int = 30
    shards: int = 2
    covered: int = 80  # percent of a phrase's count at which a longer one replaces it
    most: int = 2000  # rows of the report for each language
    filter_bits: int = 1 << 24  # of each Bloom filter
    probes: int = 3
    hash_bits: int = 64  # of a phrase's hash


# ------------------------------------------------------------------------------------------------------------ Bloom filters
def filter_of(hashes: DataFrame, p: Mining) -> np.ndarray:
    """A Bloom filter of the rows (hash), made of bitmaps of 32,768 bits on the executors; ``filter_bits`` bounds what comes back."""
    low, high = F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("hash", 32).bitwiseOR(F.lit(1).cast("long"))
    place = F.explode(F.array(*[F.pmod(low + high * i, F.lit(p.filter_bits)) for i in range(p.probes)]))
    places = hashes.select(place.alias("place")).select((F.col("place") + 1).alias("at"))
    maps = places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(-(-p.filter_bits // 8), dtype=np.uint8)
    for r in maps.collect():
        # Spark's buckets hold the numbers 1 to 32,768, 32,769 to 65,536 and so on
        part, start = np.frombuffer(r.bits, np.uint8), (r.bucket - 1) * 4096
        out[start:start + 4096] = part[:len(out) - start]
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray, p: Mining) -> np.ndarray:
    """Whether each hash passes; double hashing on its two halves, as in :func:`filter_of`."""
    size, whole = np.uint64(p.filter_bits), p.filter_bits & (p.filter_bits - 1)
    def probed(i: int, some: np.ndarray) -> np.ndarray:
        place = (some & np.uint64(0xFFFFFFFF)) + np.uint64(i) * (some >> np.uint64(32) | np.uint64(1))
        place = (place % size if whole else place & (size - np.uint64(1))).view(np.int64)
        return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

    out = probed(0, hashes)
    for i in range(1, p.probes):
        if 2 * np.count_nonzero(out) > len(out):
            out &= probed(i, hashes)
        else:  # few are left
            left = np.flatnonzero(out)
            out[left] = probed(i, hashes[left])
    return out


# ----------------------------------------------------------------------------------------------------------------- blocks
A_TO_Z = bytes(range(ord("A"), ord("Z") + 1))
#: Lower case; a space for a blank, a line feed for a character that ends a piece.
PLAIN = bytes.maketrans(A_TO_Z + b"\t" + ENDS, A_TO_Z.lower() + b" " + b"\n" * len(ENDS))


def cut(hashes: np.ndarray, p: Mining) -> np.ndarray:
    return hashes if p.hash_bits == 64 else hashes & np.uint64((1 << p.hash_bits) - 1)


def joined(hashes: np.ndarray, last: np.ndarray, p: Mining) -> np.ndarray:
    """Hashes of phrases from those of all but their last word, and of that."""
    return cut(mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + last), p)


def block(lang: str, texts: list[bytes], p: Mining) -> tuple[int, bytes, bytes, bytes]:
    """(number of words, the texts' words by number and -1 between pieces, the words' hashes, the words)."""
    from xxhash import xxh64_intdigest

    plain = (b"\n" + b"\n".join(texts) + b"\n").translate(PLAIN)
    chars = np.frombuffer(plain, np.uint8)
    ends = chars == ord("\n")
    between = ends | (chars == ord(" "))
    edges = np.flatnonzero(between[1:] != between[:-1]) + 1  # starts of words and of what is between them, by turns
    starts = edges[::2]
    cells = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(np.append(edges, len(plain)).astype(np.int32)), pa.py_buffer(plain)])
    coded = cells.take(pa.array(np.arange(0, len(edges), 2))).dictionary_encode()
    _, offsets, letters = coded.dictionary.buffers()
    offsets, letters = np.frombuffer(offsets, np.int32)[:len(coded.dictionary) + 1].tolist() if len(starts) else [0], letters.to_pybytes() if letters else b""
    words = [letters[i:j] for i, j in zip(offsets, offsets[1:])]
    piece = np.cumsum(ends, dtype=np.int32)[starts]
    at = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    ids = np.full(at[-1] + 2 if len(at) else 1, -1, dtype=np.int32)
    ids[at] = coded.indices.to_numpy()
    seed = xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
    hashes = cut(np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)), p)
    return len(starts), ids.tobytes(), hashes.tobytes(), b" ".join(words)


def blocks_of(docs: DataFrame, p: Mining) -> DataFrame:
    """The words of ``docs`` (shard, lang, text) in blocks of one language and shard, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, str], list[bytes]] = {}
        begun: dict[tuple[int, str], int] = {}
        total = 0

        def row(key: tuple[int, str]) -> pa.RecordBatch:
            made = block(key[1], waiting.pop(key), p)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((*key, *made), (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                names=["shard", "lang", "n", "ids", "hashes", "words"])

        for b in batches:
            for shard, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                text, key = text.as_py() or b"", (shard, lang)
                waiting.setdefault(key, []).append(text)
                begun[key] = begun.get(key, 0) + len(text)
                total += len(text)
                if begun[key] > BLOCK_BYTES or total > BEGUN_BYTES:
                    key = key if begun[key] > BLOCK_BYTES else max(begun, key=begun.get)
                    total -= begun.pop(key)
                    yield row(key)
        for key in list(waiting):
            yield row(key)

    return stored(docs.select("shard", "lang", "text").mapInArrow(run, BLOCKS), "shard")


# --------------------------------------------------------------------------------------------------------------- scanning
def active_hashes(ids: np.ndarray, own: np.ndarray, known: np.ndarray, live: np.ndarray, live_lengths: set[int], p: Mining) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes at all places) of the active phrases of two words and more in a block of word numbers and words' hashes."""
    fits = ids >= 0
    here = ids[fits]
    word = np.zeros(len(ids), dtype=np.uint64)
    word[fits] = own[here]
    hashes = word  # of the phrase of k - 1 words that starts at each place; fits: it ends within the piece
    for k in range(2, p.longest + 1):
        longer = fits[:-1] & fits[1:]
        if k - 1 in live_lengths:
            lately = np.zeros(len(fits), dtype=bool)
            lately[fits] = in_filter(live, own, p)[here] if k == 2 else in_filter(live, hashes[fits], p)
            start = np.flatnonzero((lately[:-1] | lately[1:]) & longer)
            start = start[in_filter(known, hashes[start], p)]
            start = start[in_filter(known, hashes[start + 1], p)]
            if len(start):
                yield k, joined(hashes[start], word[start + k - 1], p)
        if not any(x >= k for x in live_lengths):
            return
        hashes, fits = joined(hashes[:len(longer)], word[k - 1:], p), longer


def added_up(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and their counts; without ``counts`` each entry counts one."""
    if not len(hashes):
        return hashes, np.zeros(0, dtype=np.int64)
    if counts is None:
        hashes = np.sort(hashes)
    else:
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.diff(first, append=len(hashes)) if counts is None else np.add.reduceat(counts, first)


def bucket_edges(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the ordered ``hashes`` meet, and where each begins and the last ends; buckets are ranges of their upper bits."""
    bits = buckets.bit_length() - 1
    edges = np.append(np.searchsorted(hashes, np.arange(buckets, dtype=np.uint64) << np.uint64(64 - bits)), len(hashes))
    full = np.flatnonzero(np.diff(edges))
    return full, np.append(edges[full], len(hashes))


def packed(length: int, hashes: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row of ``COUNTS`` for each bucket of the ordered ``hashes``."""
    full, edges = bucket_edges(hashes, buckets)

    def cells(values: np.ndarray) -> pa.Array:
        at = (edges * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])

    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(full), length, dtype=np.int32)), pa.array(full.astype(np.int32)), cells(hashes), cells(counts.astype("<u4"))],
        names=["words", "bucket", "hashes", "counts"])


def scanned(shard: DataFrame, step: int, known: np.ndarray | None, live: np.ndarray | None, live_lengths: set[int], buckets: int, p: Mining) -> tuple[DataFrame, list]:
    """Counts of the phrases that may be active at ``step`` in the blocks of ``shard``, a row for each bucket that a task has met,
    and what to take back once they are stored. The two filters go to the executors once."""
    sent = None if known is None else shard.sparkSession.sparkContext.broadcast((known, live))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[tuple[np.ndarray, np.ndarray]] = []
        longer: dict[int, list[np.ndarray]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            if words:
                yield packed(1, *added_up(*map(np.concatenate, zip(*words))), buckets)
                words.clear()
            for k in list(longer):
                yield packed(k, *added_up(np.concatenate(longer.pop(k))), buckets)

        for b in batches:
            for ids, own in zip(b.column(0), b.column(1)):
                ids, own = np.frombuffer(ids.as_buffer(), np.int32), np.frombuffer(own.as_buffer(), np.uint64)
                if step < p.shards and len(own):
                    words.append((own, np.bincount(ids[ids >= 0], minlength=len(own))))
                    held += len(own)
                if sent is not None:
                    for k, hashes in active_hashes(ids, own, *sent.value, live_lengths, p):
                        longer.setdefault(k, []).append(hashes)
                        held += len(hashes)
                if held > AT_ONCE:
                    yield from out()
                    held = 0
        yield from out()

    return shard.select("ids", "hashes").mapInArrow(run, COUNTS), [] if sent is None else [sent]


# ---------------------------------------------------------------------------------------------------------- what was counted
def counts_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and counts packed in ``rows``."""
    hashes, counts = (b"".join(rows[name].to_pylist()) for name in ("hashes", "counts"))
    return np.frombuffer(hashes, np.uint64), np.frombuffer(counts, "<u4").astype(np.int64)


def looked_up(hashes: np.ndarray, counts: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Counts of ``some`` in the ordered ``hashes``; 0 for what is not there."""
    if not len(hashes):
        return np.zeros(len(some), dtype=np.int64)
    at = np.minimum(np.searchsorted(hashes, some), len(hashes) - 1)
    return np.where(hashes[at] == some, counts[at], 0).astype(np.int64)


def reached_at(step: int, p: Mining) -> Callable[[pa.Table], pa.Table]:
    """Finds what reaches the threshold at ``step`` in a bucket, by length, and the counts that later steps of a cycle need.

    It is given rows (step, words, bucket, hashes, counts, fresh): the tasks' counts of this step, a row for each earlier step of a
    cycle, and what had reached the threshold before. A phrase that reaches it within a cycle has a cycle's share of it in some
    step, so only phrases with such a step are added up. Counts that complete a cycle are not kept.
    """
    share = -(-p.least // p.shards)

    def run(rows: pa.Table) -> pa.Table:
        bucket, lengths, steps = rows["bucket"][0].as_py(), rows["words"].to_numpy(), rows["step"].to_numpy()
        out: list[tuple] = []
        for k in np.unique(lengths[steps == step]).tolist():
            now = added_up(*counts_of(rows.filter(pa.array((lengths == k) & (steps == step)))))
            before = [counts_of(rows.filter(pa.array((lengths == k) & (steps == at)))) for at in range(max(0, step - p.shards + 1), step)]
            some = np.unique(np.concatenate([h[n >= share] for h, n in (now, *before)]))
            total = sum(looked_up(*c, some) for c in (now, *before))
            had = rows["fresh"].filter(pa.array(lengths == k)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            fresh = some[(total >= p.least) & ~np.isin(some, had.view(np.uint64))]
            done = np.full(len(now[0]), len(before) == p.shards - 1)
            for earlier in before:
                done &= looked_up(*earlier, now[0]) > 0
            out.append((k, bucket, now[0][~done].tobytes(), now[1][~done].astype("<u4").tobytes(), fresh.view(np.int64)))
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, types)], names=["words", "bucket", "hashes", "counts", "fresh"])

    return run


def cycles(shards: list[DataFrame], buckets: int, p: Mining) -> np.ndarray | None:
    """The Bloom filter of the hashes that reached the threshold, after the steps by which all that can have done so."""
    last = {0: -1}  # last step at which a phrase of each length reached the threshold; words may start at step 0
    states: list[DataFrame] = []  # by step
    lately: list[np.ndarray] = []  # filters of what reached it, by step
    known, live, step = None, None, 0
    while any(k < p.longest and step <= at + p.shards for k, at in last.items()):
        recent = {k for k, at in last.items() if 0 < k < p.longest and at >= step - p.shards}
        counts, sent = scanned(shards[step % p.shards], step, known, live, recent, buckets, p)
        nothing = F.lit(None)
        rows = [counts.select(F.lit(step).alias("step"), "*", nothing.cast("array<long>").alias("fresh"))]
        rows += [s.select(F.lit(i).alias("step"), "words", "bucket", *["hashes", "counts"] if i > step - p.shards else [
            nothing.cast("binary").alias("hashes"), nothing.cast("binary").alias("counts")], "fresh") for i, s in enumerate(states)]
        states.append(stored(reduce(DataFrame.unionByName, rows).groupBy("bucket").applyInArrow(reached_at(step, p), REACHED)))
        for s in sent:
            s.destroy()
        fresh = states[-1].where(F.size("fresh") > 0)
        new = [r["words"] for r in fresh.select("words").distinct().collect()]  # a few lengths
        last.update({k: step for k in new})
        lately.append(filter_of(fresh.select(F.explode("fresh").alias("hash")), p))
        step += 1
        if len(last) > 1:
            known, live = lately[-1] if known is None else known | lately[-1], reduce(np.bitwise_or, lately[-p.shards:])
        release(shards[0].sparkSession)
    return known


# ------------------------------------------------------------------------------------------------------------------- texts
def block_phrases(ids: np.ndarray, own: np.ndarray, words: list[bytes], known: np.ndarray, p: Mining) -> Iterator[tuple[int, np.ndarray, list[bytes], np.ndarray]]:
    """(length, hashes, phrases, counts) of the phrases in a block whose hash passes the filter, told apart by their words."""
    inside = np.flatnonzero(ids >= 0)
    here, passed = ids[inside], in_filter(known, own, p)
    seen = np.flatnonzero(passed)
    yield 1, own[seen], [words[i] for i in seen], np.bincount(here, minlength=len(words))[seen]
    word, reached = np.zeros(len(ids), dtype=np.uint64), np.zeros(len(ids) + 1, dtype=bool)
    word[inside], reached[inside] = own[here], passed[here]
    number, phrases, hashes = ids.astype(np.int64), words, word  # of the phrase of length k - 1 that starts at each place
    for k in range(2, p.longest + 1):
        start = np.flatnonzero(reached[:-1] & reached[1:])
        found = joined(hashes[start], word[start + k - 1], p)
        passed = in_filter(known, found, p)
        start, found = start[passed], found[passed]
        if not len(start):
            return
        # a phrase of k words is its first k - 1 words and the last one
        pair, first, which, n = np.unique(number[start] << 32 | ids[start + k - 1], return_index=True, return_inverse=True, return_counts=True)
        phrases = [phrases[i] + b" " + words[j] for i, j in zip((pair >> 32).tolist(), (pair & 0xFFFFFFFF).tolist())]
        yield k, found[first], phrases, n
        number, hashes, reached = np.full(len(ids), -1, dtype=np.int64), np.zeros(len(ids), dtype=np.uint64), np.zeros(len(ids) + 1, dtype=bool)
        number[start], hashes[start], reached[start] = which, found, True


def by_text(blocks: DataFrame, known: np.ndarray, buckets: int, p: Mining) -> DataFrame:
    """(lang, words, phrase, total), stored: the phrases that reach the threshold, among those whose hash passes the filter.
    A bucket's phrases go there packed, and are added up by their text."""
    sent = blocks.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, ids, own, words in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                ids, own = np.frombuffer(ids.as_buffer(), np.int32), np.frombuffer(own.as_buffer(), np.uint64)
                for k, hashes, phrases, n in block_phrases(ids, own, words.as_py().split(b" ") if len(own) else [], sent.value, p):
                    order = np.argsort(hashes)
                    full, edges = bucket_edges(hashes[order], buckets)
                    phrases, n = [phrases[i] for i in order.tolist()], n[order].astype("<u4")
                    parts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(full), pa.string()), pa.array(np.full(len(full), k, dtype=np.int32)), pa.array(full.astype(np.int32)),
                         pa.array([b"\n".join(phrases[i:j]) for i, j in parts], pa.binary()), pa.array([n[i:j].tobytes() for i, j in parts], pa.binary())],
                        names=["lang", "words", "bucket", "phrases", "counts"])

    def add_up(rows: pa.Table) -> pa.Table:
        totals: dict[tuple[str, int], dict[bytes, int]] = {}
        for lang, k, phrases, n in zip(*(rows[x].to_pylist() for x in ("lang", "words", "phrases", "counts"))):
            own = totals.setdefault((lang, k), {})
            for phrase, count in zip(phrases.split(b"\n"), np.frombuffer(n, "<u4").tolist()):
                own[phrase] = own.get(phrase, 0) + count
        found = [(lang, k, phrase, n) for (lang, k), own in totals.items() for phrase, n in own.items() if n >= p.least]
        lang, k, phrase, n = zip(*found) if found else [[]] * 4
        return pa.Table.from_arrays([pa.array(lang, pa.string()), pa.array(k, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                                    names=["lang", "words", "phrase", "total"])

    counted = blocks.select("lang", "ids", "hashes", "words").mapInArrow(run, PACKED_PHRASES)
    out = stored(counted.groupBy("bucket").applyInArrow(add_up, PHRASES))
    sent.destroy()
    return out


def frequencies(docs: DataFrame, p: Mining) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, total) of all phrases with ``least`` occurrences or more, and (lang, n) of all words."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    blocks = blocks_of(docs.select(lang.alias("lang"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(p.shards)).cast("int").alias("shard")), p)
    words = stored(blocks.groupBy("lang").agg(F.sum("n").alias("n")))
    n = words.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << (n // BUCKET_WORDS).bit_length())
    known = cycles([blocks.where(F.col("shard") == i) for i in range(p.shards)], buckets, p)
    totals = docs.sparkSession.createDataFrame([], PHRASES) if known is None else by_text(blocks, known, buckets, p)
    return totals, words


# ------------------------------------------------------------------------------------------------------------------ scores
def scored(totals: DataFrame, p: Mining) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates: their lowest-scoring cut, ties to the earliest."""
    words = F.split("phrase", " ")
    cuts = totals.where("words > 1").select(
        "lang", "phrase", F.col("total").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), words.alias("w"), "words").select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    part = totals.select(F.struct("lang", "phrase").alias("key"), F.col("total"))
    for side, out in (("first", "l"), ("rest", "r")):
        keyed = stored(cuts.withColumn("key", F.struct("lang", F.col(side).alias("phrase"))))
        cuts = held_by_key(keyed, part.select("key", F.col("total").alias(out)), "key").drop("key")
    score = F.expr(f"CAST((CAST({SCALE} AS DECIMAL(8,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    best = cuts.withColumn("score", score).groupBy(*KEY).agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return best.select(*KEY, "a", "c.l", "c.r", "c.score")


def covered(totals: DataFrame, p: Mining) -> DataFrame:
    """(lang, phrase): candidates inside a longer candidate with enough of their count."""
    words = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    longer = totals.where("words > 2").select("lang", "words", words.alias("w"), "total").select("lang", "total", F.explode(inner).alias("phrase"))
    most = longer.groupBy(*KEY).agg(F.max("total").alias("around"))
    enough = F.expr(f"CAST(around AS DECIMAL(19,0)) * 100 >= CAST(total AS DECIMAL(19,0)) * {p.covered}")
    return totals.where("words > 1").join(most, KEY).where(enough).select(*KEY)


def collocations(docs: DataFrame, p: Mining = Mining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of each language of ``docs`` (doc_id, text, lang;
    other columns ignored).

    A null text has no words, a null lang is ``und``. Repeated rows count as often as they occur. No documents, or no phrase
    that occurs often enough: no rows.
    """
    totals, words = frequencies(docs, p)
    left = scored(totals, p).join(covered(totals, p), KEY, "left_anti")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= p.most)
    return top.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
