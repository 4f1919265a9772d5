"""Filter audit, SimHash and collocations against brute-force versions, on small texts with all the awkward cases."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidewatch.llm import collocations, common, filter_audit, simhash
from tidewatch.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, part string, mask int, step int, key long, bits long, words int, shard int, good int"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "p", 1, 2, 3, 4, 5, 6, 7) for r in rows], SCHEMA)


def prose(rng, n, names=40):
    return " ".join(f"w{int(rng.random() ** 2 * names)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, prose(rng, rng.randrange(1, 130)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, ""])) for i in range(60)]
    out += [(100 + i, out[i % 4][1], "en", "a" if i % 3 else "b") for i in range(20)]  # copies
    for i in range(25):  # near copies
        w = (prose(random.Random(5), 200)).split()
        w[(7 * i) % 200] = f"z{i}"
        out.append((200 + i, " ".join(w), "en", "c"))
    out += [(300, None, None, None), (301, "", "fr", "a"), (302, " \n\t\x0b\x0c\r ", "fr", "a"), (303, "one two", "en", "b"), (304, "ONE TWO", "en", "b"),
            (305, "x" * 5000, "en", "d"), (306, "ab. " * 3000, "en", "d"), (307, "ñandú 中文 \U0001f600 É", "fr", "d"), (308, "$a #b", "en", "d"),
            (309, "A B C " * 30, "en", "d"), (310, "nb sp  em", "fr", "d"),
            (None, "one two", "en", "b"), (None, None, None, None), (5, out[5][1], "en", "b"), (5, out[5][1], "en", "b"), (7, "another text of seven", "en", "b")]
    return out


# -------------------------------------------------------------------------------------------------------------- filter audit
def failing(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, _, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        yield i, source or "", {f for f in fails if fails[f]}


def brute_audit(rows, labels):
    good = {i for i, q, x in labels if q == 1 and i is not None}
    toxic = {i for i, q, x in labels if x == 1 and i is not None}
    out, shapley = {}, Counter()
    found = list(failing(rows))
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, p, _ in found}:
            alive = [(i, f) for i, p, f in found if p == part]
            everything = alive
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in alive if f in x]
                alive = [(i, x) for i, x in alive if f not in x]
                shapley[part, f] += len(gone)
                out[part, order, step] = (len(alive), len(gone), sum(f in x for _, x in everything) - len(gone), sum(x == {f} for _, x in everything),
                                          sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_equals_every_order_by_hand(spark, rows):
    rng = random.Random(1)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(None, 1, 1), (100, 1, 0), (100, 0, 1), (999, 1, 1)]
    got = filter_audit.audit(docs(spark, rows), spark.createDataFrame([(*x, "e", 5) for x in labels], "doc_id long, quality int, toxic int, part string, mask int"))
    assert got.dtypes[2] == ("step", "int")
    found = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got.collect()}
    assert found == brute_audit(rows, labels)


def test_filter_audit_of_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs(spark, []), labels).collect() == []
    one = filter_audit.audit(docs(spark, [(None, None, None, None)]), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.shapley for r in one} == {0, 120}


def test_gray_walk_counts_survivors_of_every_subset():
    cells = np.random.default_rng(0).integers(0, 9, (3, 2, 32))
    states = filter_audit.survivors(cells)
    for subset in range(32):
        assert (states[:, :, subset] == cells[:, :, [m for m in range(32) if not m & subset]].sum(axis=-1)).all()


# ------------------------------------------------------------------------------------------------------------------- SimHash
def brute_fingerprint(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def brute_simhash(rows):
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in rows if i is not None]
    pairs = {(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= 2}
    return brute_components({i for i, _ in prints}, pairs)


def test_simhash_equals_all_pairs(spark, rows):
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(r.fingerprint for r in got) == sorted(f"{brute_fingerprint(t):016x}" for _, t, *_ in rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute_simhash(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("pairwise", [1, 3, 64, 100_000])
def test_links_of_lists_are_those_of_all_pairs(spark, pairwise):
    """Fingerprints in chains and in full balls around a centre, whatever the size up to which lists are compared by pairs."""
    rng = random.Random(pairwise)
    prints = {rng.getrandbits(64) for _ in range(200)}
    centre = rng.getrandbits(64)
    prints |= {centre ^ m for m in simhash.near_masks((0, 7), 2)}
    for _ in range(100):
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints |= {0, (1 << 64) - 1, 1 << 63}
    heads = {x: 10 + i for i, x in enumerate(sorted(prints))}
    classes = spark.createDataFrame([(simhash.signed(x), h) for x, h in heads.items()], "bits long, head long")
    p = simhash.SimHash(pairwise=pairwise)
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(classes, p).collect()}
    every = {tuple(sorted((heads[x], heads[y]))) for x in prints for y in prints if x < y and (x ^ y).bit_count() <= p.bits}
    assert got and brute_components(heads.values(), got) == brute_components(heads.values(), every)


def test_values_of_hot_keys_are_found(spark):
    held = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, 7, id) AS k", "'x' AS more")
    values = spark.range(0, 6000, 2).selectExpr("id AS k", "id * 2 AS v").union(spark.createDataFrame([(7, 14)], "k long, v long"))
    got = {r.id: r.v for r in common.held_by_key(held, values, "k").collect()}
    assert got == {i: 14 if i % 3 == 0 or i == 7 else 2 * i if i % 2 == 0 else None for i in range(5000)}


# -------------------------------------------------------------------------------------------------------------- collocations
def brute_collocations(rows, p):
    f, n = Counter(), Counter()
    for _, t, lang, _ in rows:
        lang = "und" if lang is None else lang
        t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, p.longest + 1):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= p.least}
    dropped = {(g[0], *g[i:i + m]) for g, a in candidates.items() for m in range(2, len(g) - 1) for i in range(1, len(g) - m + 1)
               if 100 * a >= p.covered * f[g[0], *g[i:i + m]]}
    out = defaultdict(list)
    for g, a in candidates.items():
        if g not in dropped:
            cuts = [(int(Fraction(2_000_000 * a, f[g[:k + 1]] + f[g[0], *g[k + 1:]])), k) for k in range(1, len(g) - 1)]
            score, k = min(cuts)
            out[g[0]].append((-score, -a, " ".join(g[1:]).encode(), f[g[:k + 1]], f[g[0], *g[k + 1:]]))
    return sorted((lang, rank, ph.decode(), -a, left, right, n[lang], -score) for lang, found in out.items()
                  for rank, (score, a, ph, left, right) in enumerate(sorted(found)[:p.most], 1))


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(9)
    fixed = ["red green blue grey", "red green", "up down", "É è ç", "New York", "a. b", "of the", "of\tthe", "long\x0bcut", "中文 词"]
    out = []
    for i in range(150):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else prose(rng, 3, 12) for _ in range(40)]
        out.append((i, rng.choice([" ", ", "]).join(parts), rng.choice(["en", "fr", "und", None]), "s"))
    return out + [(900, None, "en", "s"), (901, "", None, "s"), (902, " . , ", "fr", "s"), (903, "rare " * 29, "de", "s"), (904, "often " * 400, "de", "s"),
                  (905, "z" * 3000, "de", "s"), (None, "red green blue grey", "en", "s")] + [(7, "same row here", "en", "s")] * 40


@pytest.mark.parametrize("shards, filter_bits, most", [(2, 1 << 16, 5), (3, 40, 2000)])
def test_collocations_equal_counting_everything(spark, phrases, shards, filter_bits, most):
    """Also with a filter so small that nearly every phrase passes it."""
    p = collocations.Mining(least=30 if shards < 3 else 12, shards=shards, filter_bits=filter_bits, most=most)
    got = collocations.collocations(docs(spark, phrases), p)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    assert sorted(map(tuple, got.collect())) == brute_collocations(phrases, p)


def test_collocations_tell_phrases_of_one_hash_apart(spark, phrases):
    p = collocations.Mining(hash_bits=7)
    assert sorted(map(tuple, collocations.collocations(docs(spark, phrases), p).collect())) == brute_collocations(phrases, p)


def test_a_scan_leaves_a_row_for_each_bucket_and_length(spark):
    """However many phrases there are: a row for each of them was what a step shuffled, sorted and joined."""
    p, n, buckets = collocations.Mining(), 3000, 16
    text = " ".join(f"w{i}" for i in range(n)) + ". w0 w1. w0 w1"
    blocks = collocations.blocks_of(spark.createDataFrame([(0, "en", text)], "shard int, lang string, text string"), p)
    everything = np.full(p.filter_bits // 8, 255, dtype=np.uint8)
    counts, sent = collocations.scanned(blocks, 0, everything, everything, {1, 2, 3}, buckets, p)
    rows = counts.collect()
    assert len(rows) <= p.longest * buckets and len(sent) == 1
    for k, distinct in enumerate((n, n - 1, n - 2, n - 3), 1):
        mine = sorted((r for r in rows if r.words == k), key=lambda r: r.bucket)
        hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in mine])
        found = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in mine])
        assert len(hashes) == distinct and (np.diff(hashes.astype(object)) > 0).all()
        assert Counter(found.tolist()) == ({1: n - 2, 3: 2} if k == 1 else {1: n - 2, 3: 1} if k == 2 else {1: distinct})


def test_a_phrase_reaches_the_threshold_once_over_a_cycle():
    p = collocations.Mining()
    schema = pa.schema([("step", pa.int32()), ("words", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("fresh", pa.list_(pa.int64()))])

    def row(step, counts, fresh=()):
        return {"step": step, "words": 2, "bucket": 3, "hashes": np.array(sorted(counts), np.uint64).tobytes(),
                "counts": np.array([counts[h] for h in sorted(counts)], "<u4").tobytes(), "fresh": list(fresh)}

    def at(step, *rows):
        (r,) = collocations.reached_at(step, p)(pa.Table.from_pylist(list(rows), schema)).to_pylist()
        return r["fresh"], dict(zip(np.frombuffer(r["hashes"], np.uint64).tolist(), np.frombuffer(r["counts"], "<u4").tolist()))

    # two tasks' counts of one step; 5 reaches it by itself, 6 with the step before, 7 has a complete cycle and too little, 8 is new
    fresh, kept = at(2, row(2, {5: 20, 8: 3}), row(2, {5: 10, 6: 16, 7: 1}), row(1, {6: 14, 7: 28, 9: 29}))
    assert sorted(fresh) == [5, 6] and kept == {5: 30, 8: 3}
    assert at(3, row(3, {5: 30, 8: 26, 10: 14}), row(2, kept, fresh)) == ([], {10: 14})


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs(spark, [])).collect() == []
    assert collocations.collocations(docs(spark, [(1, "too rare to count", "en", "s")])).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    totals = spark.createDataFrame([("en", 1, "x", big), ("en", 1, "y", big - 7), ("en", 2, "x y", big - 9)], "lang string, words int, phrase string, total long")
    (r,) = collocations.scored(totals, collocations.Mining()).collect()
    assert r.score == 2_000_000 * (big - 9) // (big + big - 7)
    more = totals.union(spark.createDataFrame([("en", 1, "z", big), ("en", 2, "y z", 100), ("en", 3, "x y z", 80)], totals.schema))
    assert [tuple(r) for r in collocations.covered(more, collocations.Mining()).collect()] == [("en", "y z")]


# ------------------------------------------------------------------------------------------------------- registered queries
def test_registered_queries_give_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert llm_queries.QUERIES["op12_simhash"](spark, SF).count() == n
    assert {"op11_filter_audit", "op13_collocations"} <= set(llm_queries.ORACLES)
