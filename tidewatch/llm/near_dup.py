"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

A document is the set of its distinct 5-word shingles. Documents with equal sets are one class from the start. The
signatures of the classes are cut into bands; classes that share a band meet in a bucket.

* Each class is first held against the heaviest one of its largest bucket, the one that meets most others. After that the heaviest of
  each bucket, and two more centres of large ones, are held against what is not in their component yet. Most buckets are one
  component by then and are done: n copies cost a few n pairs.
* What is still apart is compared across components: pair by pair in buckets of few members, else by what tells each class from
  the heaviest one of the bucket's largest component. A class that is not linked with that one is linked only with classes that share
  much of its difference, so a group of copies is not paired with all who lie just beyond the bound. No pair is passed over
  that could join two components.
* Sets whose sizes alone keep them under the bound are never paired.
* A pair is compared batch by batch of the signature and dropped as soon as the posterior probability that its similarity
  reaches the bound falls under the chosen miss probability; what survives is verified on the full sets.

Two sets at the bound share no band with probability (1 - t^rows)^bands, 8e-7 as set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, mix64, stored, text_bytes

SIGNATURES = "doc_id long, n_shingles long, set_key binary, signature binary"
#: Words whose hash a worker keeps; beyond it the store starts afresh, which changes no result.
KEPT_WORDS = 1_000_000
#: Shingles hashed for all signature places at once.
BLOCK = 1024


@dataclass(frozen=True)
class NearDup:
    words: int = 5
    percent: int = 85  # link: 100 * intersection >= percent * union
    bands: int = 24
    rows: int = 5
    stars: int = 2  # further centres of large buckets
    small: int = 64  # members up to which a bucket has one centre
    few: int = 8  # members up to which a bucket's components are compared pair by pair
    miss: float = 1e-7  # posterior probability under which a pair is dropped
    seed: int = 20_231

    @property
    def size(self) -> int:
        return self.bands * self.rows


class Shingler:
    """Distinct hashed shingles of texts: A-Z lower-cased, words between blanks and control blanks."""

    def __init__(self, words: int):
        self.n, self.index = words, {}
        self.odd = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        tokens = text_bytes(text).lower().split()
        if not tokens:
            return np.zeros(0, np.uint64)
        index = self.index
        if len(index) > KEPT_WORDS:
            index.clear()
        for w in set(tokens).difference(index):
            index[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(index.__getitem__, tokens), np.uint64, len(tokens))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            out = mix64(out ^ (h[k:len(h) - n + 1 + k] * self.odd[k]))
        return np.unique(out)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set, as 32-bit numbers."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), BLOCK):
        np.minimum(best, (factors[:, None] * shingles[None, lo:lo + BLOCK]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame, p: NearDup) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) of each row; an empty set has neither key nor signature."""
    factors = np.random.default_rng(p.seed).integers(0, 1 << 63, p.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingles = Shingler(p.words)
        for b in batches:
            rows = []
            for text in b["text"]:
                s = shingles(text)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s, factors).tobytes()) if len(s) else (0, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_key", "signature"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy() if len(b) else np.zeros(0, np.int64))
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SIGNATURES)


def drop_below(size: int, step: int, bound: float, miss: float) -> list[tuple[int, int]]:
    """(places compared, least matches to go on): with a uniform prior, the posterior probability of similarity >= bound
    after m of n matches is P(Binomial(n + 1, bound) <= m); fewer matches make it smaller than ``miss``."""
    out = []
    for n in range(step, size + 1, step):
        total, least = 0.0, 0
        for m in range(n + 1):
            total += comb(n + 1, m) * bound ** m * (1 - bound) ** (n + 1 - m)
            if total >= miss:
                least = m
                break
        out.append((n, least))
    return out


def compared(pairs: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """Those of the pairs (a, b) that have to be verified. Signatures are compared a batch of bands at a time; the sizes of
    the sets bound their similarity as well."""
    bounds = drop_below(p.size, 4 * p.rows, p.percent / 100, p.miss)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            one = np.frombuffer(b"".join(x["sig_a"]), "<u4").reshape(-1, p.size)
            two = np.frombuffer(b"".join(x["sig_b"]), "<u4").reshape(-1, p.size)
            sizes = x[["n_a", "n_b"]].to_numpy()
            live, matches, done = np.flatnonzero(100 * sizes.min(axis=1) >= p.percent * sizes.max(axis=1)), np.zeros(len(x), np.int64), 0
            for upto, least in bounds:
                matches[live] += (one[live, done:upto] == two[live, done:upto]).sum(axis=1)
                live, done = live[matches[live] >= least], upto
            yield pd.DataFrame({"a": x["a"].to_numpy()[live], "b": x["b"].to_numpy()[live]})

    left = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("sig_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("sig_b"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """(a, b, both, either): sizes of the intersection and union of the full sets of each pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(p.words)
        last, kept = None, None
        for x in batches:
            rows = []
            for a, b, s, t in zip(x["a"], x["b"], x["text_a"], x["text_b"]):
                if a != last:
                    last, kept = a, shingles(s)
                other = shingles(t)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                rows.append((a, b, both, len(kept) + len(other) - both))
            yield pd.DataFrame(rows, columns=["a", "b", "both", "either"])

    first = pairs.join(texts, F.col("b") == F.col("doc_id")).select("a", "b", F.col("text").alias("text_b"))
    both = first.join(texts, F.col("a") == F.col("doc_id")).select("a", "b", F.col("text").alias("text_a"), "text_b")
    return both.mapInPandas(run, "a long, b long, both long, either long")


def labelled(members: DataFrame, found: list[DataFrame]) -> DataFrame:
    """``members`` with the component that the links found so far put each class in."""
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    labels = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    return members.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def deltas(refs: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """What tells each member from its reference c, of ``refs`` (c, doc_id, label, same): a row for each shingle in a prefix of the
    difference, in one order for all members of a reference (shingles that c lacks first), or one row with no ``pos`` for
    a member of another component that is linked with c.

    A pair of members is linked if and only if (100 + percent) * o >= (percent - 100) * |c| + percent * added + 100 * removed, with o
    shingles of both differences, added and removed being those of the two members together. If one of them, f, is not linked
    with c, that is positive for the other one alone, and o >= (percent * |f or c| - 100 * |f and c|) / 100. So the differences
    meet in the first |difference| - (least o) + 1 shingles of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(p.words)
        last, kept = None, None
        for x in batches:
            for c, doc, label, same, s, t in zip(x["c"], x["doc_id"], x["label"], x["same"], x["text_c"], x["text"]):
                if c != last:
                    last, kept = c, shingles(s)
                own = shingles(t)
                more, less = np.setdiff1d(own, kept, assume_unique=True), np.setdiff1d(kept, own, assume_unique=True)
                short = p.percent * (len(kept) + len(more)) - 100 * (len(kept) - len(less))  # above 0: not linked with c
                far = short > 0 and not same
                least = -(-short // 100) if far else (p.percent * len(more) + 100 * len(less)) // (100 + p.percent) + 1
                elem = np.concatenate([np.sort(more), np.sort(less)])[:max(0, len(more) + len(less) - least + 1)].view(np.int64)
                out = pd.DataFrame({"elem": elem, "pos": np.arange(len(elem), dtype=np.int32)}).astype({"pos": "Int32"})
                if short <= 0 and not same:
                    out = pd.concat([out, pd.DataFrame({"elem": [0], "pos": pd.array([None], "Int32")})])
                if len(out):
                    yield out.assign(c=c, doc_id=doc, label=label, far=far, added=len(more), removed=len(less), whole=len(kept))

    kinds = "elem long, pos int, c long, doc_id long, label long, far boolean, added int, removed int, whole int"
    first = refs.join(texts, "doc_id")
    both = first.join(texts.select(F.col("doc_id").alias("c"), F.col("text").alias("text_c")), "c")
    return both.select("c", "doc_id", "label", "same", "text_c", "text").mapInPandas(run, kinds)


def met(rows: DataFrame, p: NearDup) -> DataFrame:
    """Pairs (a, b) of different components that :func:`deltas` leaves possible. From a shared shingle on, no more can be shared
    than is left of the shorter difference; at the first one they share, that has to be enough."""
    far = rows.where("far AND pos IS NOT NULL").select("c", "elem", F.col("doc_id").alias("o"), F.col("label").alias("of"), F.col("pos").alias("o_pos"),
                                                       F.col("added").alias("o_added"), F.col("removed").alias("o_removed"))
    left = F.least(F.col("added") + F.col("removed") - F.col("pos"), F.col("o_added") + F.col("o_removed") - F.col("o_pos"))
    need = (p.percent - 100) * F.col("whole") + p.percent * (F.col("added") + F.col("o_added")) + 100 * (F.col("removed") + F.col("o_removed"))
    shared = rows.where("pos IS NOT NULL").join(far, ["c", "elem"]).where(F.expr("label <> of AND (NOT far OR o < doc_id)") & ((100 + p.percent) * left >= need))
    return shared.select(F.least("o", "doc_id").alias("a"), F.greatest("o", "doc_id").alias("b")).distinct()


def links(sets: DataFrame, texts: DataFrame, p: NearDup) -> list[DataFrame]:
    """Tables (a, b) of links between classes whose components are those of all links. ``sets`` and ``texts`` have a row
    for each class, (doc_id, n_shingles, signature) and (doc_id, text)."""
    width = 4 * p.rows
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * width + 1, F.lit(width)))))
    rows = sets.select("doc_id", F.col("n_shingles").alias("size"), band.alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met_in = stored(rows.join(shared, "bucket"))
    # the class that meets most others is the likeliest to be what the others are copies of
    members = stored(met_in.join(met_in.groupBy("doc_id").agg(F.sum("n").alias("w")), "doc_id"))
    # only classes that share a bucket are looked at again; the same join at any size
    ids = stored(members.select("doc_id").distinct())
    pool = stored(texts.join(ids.hint("merge"), "doc_id", "left_semi"))
    signed = stored(sets.join(ids.hint("merge"), "doc_id", "left_semi"))
    order = F.struct("w", (-F.col("doc_id")).alias("earlier"))

    def alike(x: str, y: str) -> Column:  # sets of other sizes cannot reach the bound
        return 100 * F.least(x, y) >= p.percent * F.greatest(x, y)

    def linked(pairs: DataFrame) -> DataFrame:
        maybe = stored(compared(pairs.distinct(), signed, p))
        exact = verified(maybe, pool, p)
        return stored(exact.where(100 * F.col("both") >= p.percent * F.col("either")).select("a", "b"))

    # one pair for each class: the centre of its largest bucket
    middle = members.groupBy("bucket").agg(F.max_by(F.struct("doc_id", "size"), order).alias("c"))
    beside = members.join(middle, "bucket").where((F.col("doc_id") != F.col("c.doc_id")) & alike("size", "c.size"))
    first = beside.groupBy("doc_id").agg(F.max_by("c.doc_id", F.struct("n", "bucket")).alias("a"))
    found = [linked(first.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")))]
    # the centres of all its buckets, and further ones of large buckets, that are not in its component yet
    now = stored(labelled(members, found))
    one = F.struct("doc_id", "label", "size")
    star = [F.min_by(one, F.xxhash64("doc_id", F.lit(k))) for k in range(p.stars)]
    centres = now.groupBy("bucket").agg(F.max_by(one, order).alias("c"), F.max("n").alias("n"), *[c.alias(f"c{k}") for k, c in enumerate(star)])
    several = F.when(F.col("n") > p.small, F.array("c", *[f"c{k}" for k in range(p.stars)])).otherwise(F.array("c"))
    apart = now.join(centres.select("bucket", F.explode(F.array_distinct(several)).alias("c")), "bucket").where((F.col("label") != F.col("c.label")) & alike("size", "c.size"))
    found.append(linked(apart.select(F.least("c.doc_id", "doc_id").alias("a"), F.greatest("c.doc_id", "doc_id").alias("b"))))
    # what is still apart in a bucket: every pair of different components in buckets of few members
    now = labelled(members, found)
    sizes = now.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"), F.max("w").alias("w"))
    split = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("held"), F.max_by("label", F.struct("k", "w", "label")).alias("main")).where("parts > 1")
    mixed = stored(now.join(split.select("bucket", "main", "held"), "bucket").select("bucket", "main", "held", "doc_id", "label", "size"))
    few = mixed.where(F.col("held") <= p.few)
    outside = few.where("label <> main").select("bucket", F.col("doc_id").alias("o"), F.col("label").alias("of"), F.col("size").alias("o_size"))
    rest = few.join(outside, "bucket").where(F.expr("label <> of AND (label = main OR o < doc_id)") & alike("size", "o_size"))
    # and in the others those whose differences from the heaviest class of the largest component have enough in common
    heads = now.groupBy("label").agg(F.max_by("doc_id", order).alias("c")).withColumnRenamed("label", "main")
    refs = mixed.where(F.col("held") > p.few).select("main", "doc_id", "label").distinct().join(heads, "main").where("doc_id <> c")
    differing = stored(deltas(refs.select("c", "doc_id", "label", (F.col("label") == F.col("main")).alias("same")), pool, p))
    found.append(stored(differing.where("pos IS NULL").select(F.least("c", "doc_id").alias("a"), F.greatest("c", "doc_id").alias("b"))))
    found.append(linked(rest.select(F.least("o", "doc_id").alias("a"), F.greatest("o", "doc_id").alias("b")).union(met(differing, p))))
    return found


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns ignored).

    A text without words is linked with nothing; a row without doc_id keeps no component (null) and is kept. Rows that
    share a doc_id are linked through it.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_sets = stored(signatures(base, p))
    usable = all_sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = usable.groupBy("set_key").agg(F.min("doc_id").alias("first"))
    member = stored(usable.select("doc_id", "n_shingles", "set_key").join(first, "set_key"))
    heads = stored(usable.join(member.where("doc_id = first").select("doc_id", "set_key").distinct(), ["doc_id", "set_key"], "left_semi")
                   .dropDuplicates(["doc_id", "set_key"]).select("doc_id", "set_key", "n_shingles", "signature"))
    # a class is named by its smallest doc_id; where rows share one, by the first of its sets
    sets = stored(heads.dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "signature"))
    found = links(sets, base.where("doc_id IS NOT NULL AND text IS NOT NULL"), p)
    edges = member.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    for e in found:
        edges = edges.union(e)
    labels = components(edges.select("a", "b"))
    named = all_sets.select("doc_id", "n_shingles").join(labels, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
