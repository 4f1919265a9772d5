"""Every operator against a brute-force version, on small texts with all the awkward cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import common, decontaminate, language, licenses, near_dup, packing, parsing_dedup, secrets, token_files, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, row int, start int, score int, doc int, kind int, part int"


def docs(spark, rows):
    """A documents table with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5, 6, 7) for i, t in rows], SCHEMA)


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(8, 120)) for _ in range(25)]
    passage = prose(rng, 60)
    rows = [(3 * i, t) for i, t in enumerate(base)]
    rows += [(200 + i, base[i % 3]) for i in range(9)]  # copies
    for i in range(30):  # near copies of one text, each changed elsewhere
        w = base[4].split() * 2
        w[(5 * i) % len(w)] = f"changed{i}"
        rows.append((300 + i, " ".join(w)))
    rows += [(400, passage + " " + base[5]), (401, base[6] + " é" + passage), (402, passage * 3)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one two"), (504, "ONE two"), (505, "a" * 5000), (506, "ab " * 3000),
             (507, "ñandú 中文 \U0001f600 x"), (508, "..!!"), (509, prose(rng, 4000))]
    return rows


# ------------------------------------------------------------------------------------------------ near duplicates
def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sets, label


def test_near_duplicates_equal_all_pairs(spark, corpus):
    sets, label = brute_components(corpus)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs(spark, corpus)).collect()}
    assert {i: r.component_id for i, r in got.items()} == label
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert len(set(label.values())) < len(label) - 30


def test_near_duplicates_of_odd_rows(spark):
    assert near_dup.near_duplicates(docs(spark, [])).collect() == []
    rows = near_dup.near_duplicates(docs(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "g h i j k l m"), (2, "g h i j k l m")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in rows if r.doc_id is not None) == [(False, 2, 2, True), (False, 4, 2, False), (False, 4, 2, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_no_link_is_lost_across_centres(spark):
    """x is linked to the centre, y to x but not to the centre: one bucket, three rounds' worth of cases."""
    words = [f"w{i}" for i in range(400)]
    near = lambda lo, hi: " ".join([*words[:lo], *[f"z{i}" for i in range(lo, hi)], *words[hi:]])
    rows = [(1, " ".join(words)), (2, near(0, 25)), (3, near(0, 48)), (4, near(0, 72)), (5, near(0, 300))]
    _, label = brute_components(rows)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert got == label and len(set(label.values())) == 2


def test_a_large_group_of_near_copies_costs_few_pairs(spark, monkeypatch):
    """Each copy is paired with one centre first: nearly every band's centre was before."""
    rng, counts, compared = random.Random(29), [], near_dup.compared
    base = prose(rng, 400).split()

    def counted(pairs, sets, p):
        counts.append(pairs.count())
        return compared(pairs, sets, p)

    monkeypatch.setattr(near_dup, "compared", counted)
    rows = [(i, " ".join(f"new{i}" if k == (37 * i) % 400 else w for k, w in enumerate(base))) for i in range(80)]
    rows += [(1000 + i, " ".join(base[:100 + 20 * i])) for i in range(10)]  # prefixes: many of them too short to be linked
    _, label = brute_components(rows)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows)).collect()} == label
    assert sum(counts) <= 2 * len(rows), counts


def test_copies_beyond_the_bound_are_not_paired_with_the_whole_group(spark, monkeypatch):
    """Copies with one to six words changed: those that are not linked with their source share bands with hundreds of others."""
    rng, counts, compared = random.Random(31), [], near_dup.compared
    base = prose(rng, 150).split()
    rows = [(1, " ".join(base))]
    for i in range(2, 260):
        at = set(rng.sample(range(150), rng.randrange(1, 7)))
        rows.append((i, " ".join(f"new{rng.randrange(400)}" if k in at else w for k, w in enumerate(base))))
    far = [t.split() for _, t in rows if sum(a != b for a, b in zip(t.split(), base)) == 6][:12]
    rows += [(1000 + i, " ".join([*w[:70], "alone", *w[71:]])) for i, w in enumerate(far)]  # linked with a far copy alone
    rows += [(2000 + i, " ".join(w[:140])) for i, w in enumerate(far)]

    def counted(pairs, sets, p):
        counts.append(pairs.count())
        return compared(pairs, sets, p)

    monkeypatch.setattr(near_dup, "compared", counted)
    _, label = brute_components(rows)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, rows)).collect()} == label
    assert len({label[1000 + i] for i in range(12)}) > 3 and sum(counts) <= 20 * len(rows), counts


def test_pipeline_stage_drops_near_copies_from_080_on(spark, corpus):
    import corpus_pipeline

    rng, rows = random.Random(11), list(corpus)
    for i in range(12):  # 2 words of 100 changed: 86 of 106 shingles; 3 words: 81 of 111
        base = prose(rng, 100).split()
        change = lambda *at: " ".join("other" if k in at else w for k, w in enumerate(base))  # noqa: E731,B023
        rows += [(1000 + 3 * i, " ".join(base)), (1001 + 3 * i, change(30, 60)), (1002 + 3 * i, change(20, 50, 80))]
    _, label = brute_components(rows, 80)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "").collect()}
    assert kept == {i for i, c in label.items() if i == c}
    assert len({*label.values()}) < len({*brute_components(rows)[1].values()}) - 9


def test_bayesian_bounds_are_sequential_and_rarely_wrong():
    bounds = near_dup.drop_below(120, 20, 0.85, 1e-7)
    assert [n for n, _ in bounds] == [20, 40, 60, 80, 100, 120]
    rng = np.random.default_rng(1)
    hits = rng.random((20_000, 120)) < 0.85
    assert all((hits[:, :n].sum(axis=1) >= least).all() for n, least in bounds)
    low = rng.random((2_000, 120)) < 0.5
    assert (low.sum(axis=1) < bounds[-1][1]).mean() > 0.95


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201)], "a long, b long")
    got = {r.node: r.component for r in common.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}


# ------------------------------------------------------------------------------------------------ repeated passages
def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k:k + 100]
            if w in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(parsing_dedup, "BUCKET", 1 << 14)  # several buckets
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in parsing_dedup.remove_repeats(docs(spark, corpus)).collect()}
    assert got == brute_repeats(corpus)
    assert sum(x[1] for x in got.values()) > 10_000


def test_repeats_of_odd_rows(spark):
    assert parsing_dedup.remove_repeats(docs(spark, [])).collect() == []
    long = "".join(f"{i:04d}," for i in range(60))
    rows = parsing_dedup.remove_repeats(docs(spark, [(None, long), (1, long), (1, long), (0, None)]), with_text=True).collect()
    assert sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in rows) == [(False, 0, 0), (False, 300, 300), (False, 300, 300), (True, 300, 0)]
    assert [list(s) for s in rows[0].spans] in ([], [[0, 300]])


def test_phrases_do_not_depend_on_pieces():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 103, 5000).astype(np.uint8)
    core, cls, place, count = parsing_dedup.phrases(raw)
    assert count.sum() == len(raw) - 99 and (np.cumsum(count) - count == place).all()
    inner = parsing_dedup.phrases(raw[1000:3000])
    same = set(zip(cls.tolist(), (place - 1000).tolist())) & set(zip(inner[1].tolist(), inner[2].tolist()))
    assert len(same) >= len(inner[1]) - 2


# ------------------------------------------------------------------------------------------------ token files, packing
def plain_ids(text):
    return list(tokens.tokenizer(tokens.default_path()).encode(text or "", add_special_tokens=False).ids) + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, corpus):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_file_digest(docs(spark, corpus)).collect()}
    at, want = 0, {}
    for i, t in sorted(corpus):
        ids = plain_ids(t)
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_token_files_of_odd_rows(spark):
    assert token_files.token_file_digest(docs(spark, [])).collect() == []
    rows = token_files.token_file_digest(docs(spark, [(5, "b"), (5, "a"), (None, "c"), (1, None)])).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in rows if r.doc_id is not None) == [(2, 1, 1), (3, 5, 2), (5, 5, 2)]
    assert [(r.start, r.ids_crc32) for r in rows if r.doc_id is None] == [(0, crc(plain_ids("c")))]


@pytest.mark.parametrize("numbers", [[], [0], [255, 256], [65535, 65536, 1 << 24, (1 << 32) - 1, 7], list(range(1000))])
def test_variable_length_coding(numbers):
    control, data = token_files.encode(np.array(numbers, "<u4"))
    assert len(control) == -(-len(numbers) // 4)
    assert len(data) == sum(max(1, (n.bit_length() + 7) // 8) for n in numbers)
    assert token_files.decode(control, data, len(numbers)).tolist() == numbers


def test_packing_places_every_piece_once(spark, corpus):
    got = packing.pack_documents(docs(spark, corpus), limit=256).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in corpus:
        ids, pieces = plain_ids(t), sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, s, n) for k, (s, n) in enumerate(packing.cut_points(len(ids), 256))]
        assert all(r.ids_crc32 == crc(ids[r.start:r.start + r.length]) for r in pieces)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 256
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 256) * 1.1 + 1
    assert packing.pack_documents(docs(spark, [])).collect() == []


def test_best_two_fit_exchanges_the_smallest():
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(plan) == [((3,), 1), ((6, 2, 2), 1)]  # 6 + 3 leaves 1; 2 + 2 in the place of 3 leaves none
    rng = random.Random(1)
    counts = {rng.randrange(1, 1025): rng.randrange(1, 50) for _ in range(200)}
    plan = packing.best_two_fit(counts, 1024)
    used = {}
    for lengths, times in plan:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts and len(plan) <= 1024
    lower = sum(k * n for k, n in counts.items()) / 1024
    assert sum(t for _, t in plan) <= 1.03 * lower + 1


# ------------------------------------------------------------------------------------------------ licences
def brute_places(text):
    w = [x for x in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), places


def test_license_scan_equals_brute_force(spark):
    rows = [(1, "the GNU, General\nPublic-License and MIT license mit LICENSE apache license"), (2, None), (3, ""), (4, "cc by cc by-sa CC BY"),
            (5, "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) AND BSD-3-Clause"), (6, "mit licensed, émit license"),
            (7, "SPDX-License-Identifier: MIT AND"), (None, "mit license"), (8, "x " * 4000 + "apache license")]
    for r in licenses.scan(docs(spark, rows)).collect():
        n, places = brute_places(dict(rows)[r.doc_id])
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if r.doc_id == 5:
            assert r.labels == "bsd-3-clause,gpl,mit" and r.score == 1.0
        if r.doc_id == 7:
            assert r.labels == "mit" and r.score == 0.25
    assert licenses.scan(docs(spark, [])).collect() == []


def test_expressions():
    assert licenses.parse("mit or apache-2.0 and bsd") == (["mit", "apache-2.0", "bsd"], True)
    assert licenses.parse("(gpl-2.0 with autoconf-exception or mit) and isc") == (["gpl-2.0 with autoconf-exception", "mit", "isc"], True)
    assert licenses.parse("mit */ more words") == (["mit"], True)
    assert licenses.parse("(mit or")[1] is False and licenses.parse(") mit")[1] is False and licenses.parse("") == ([], False)


# ------------------------------------------------------------------------------------------------ secrets
def strong_spans(text):
    text = text or ""
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
             ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    return sorted((m.start(), k, name, m.end()) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= least)


def test_secret_scan_equals_brute_force(spark):
    key = "AKIA" + "Z9" * 8
    rows = [(1, f"é\U0001f600 password: hunter2hunter2 {key} and {'0a' * 20}"), (2, None), (3, ""), (4, "token: token: abcdefghij secret=short"),
            (5, "API_KEY = 'abc.def-ghi+jk' apikey\":\"0123456789abcdef0123456789abcdef\""), (6, key + "AKIA" + "x"), (7, "f" * 31 + "g" + "f" * 33),
            (8, "login: someone at https://example.org/x with Zx9Kq2Lm8Pn4Rt6Vw1Ys3 "), (9, "a string Zx9Kq2Lm8Pn4Rt6Vw1Ys3 alone, https://example.org/"),
            (9, "token=aaaaaaaaaaaa"), (None, "secret=bbbbbbbbbb"), (10, ("passwd=" + "q" * 9 + " ") * 500)]
    got = secrets.scan(docs(spark, rows)).collect()
    digest = lambda t: hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, n, e in strong_spans(t)).encode()).hexdigest()
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == sorted((str(i), digest(t)) for i, t in rows)
    counts = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex) for r in got)
    assert counts == sorted((str(i), *[sum(s[2] == k for s in strong_spans(t)) for k in ("assign", "access", "hex")]) for i, t in rows)
    by = {r.doc_id: r.spans for r in got if r.doc_id in (2, 8)}
    assert by[2] == "" and [s.split(":")[0] for s in by[8].split(",")] == ["identifier", "endpoint", "opaque"]
    assert [r.spans for r in got if r.doc_id == 9 and not r.n_assign] == [""]  # weak parts that nothing completes
    assert secrets.scan(docs(spark, [])).collect() == []


def test_masking_keeps_rows_and_columns(spark):
    rows = [(1, "x password: hunter2hunter2 y"), (2, None), (3, "plain"), (3, "token=" + "0a" * 20)]
    got = secrets.masked(docs(spark, rows), "[secret]")
    assert got.columns == docs(spark, rows).columns
    assert sorted((r.doc_id, r.text or "", r.n_chars) for r in got.collect()) == [(1, "x [secret] y", 12), (2, "", 0), (3, "[secret]", 8), (3, "plain", 5)]


# ------------------------------------------------------------------------------------------------ benchmark leaks
def test_decontamination_finds_other_numbers_and_names(spark):
    item = "A train with Maria leaves at 10 km and drives 25 km before Maria stops for 10 minutes near the old station"
    other = "a train with Peter leaves at 70 km and drives 31 km before Peter stops for 9 minutes near the old station"
    mixed = "A train with Peter leaves at 70 km and drives 31 km before Oscar stops for 9 minutes near the old station"
    rows = [(1, "Intro words. " + item + " end."), (2, other), (3, "nothing of this kind stands here at all, only 10 km"), (4, None), (5, ""),
            (6, item.lower()), (None, item), (7, ("word " * 5000) + item), (1, "again")]
    bench = spark.createDataFrame([(10, item, 0), (11, None, 0), (12, "too short", 0), (13, "four words stand here", 0), (None, "x y z", 0)], "item_id long, text string, start int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, [*rows, (8, "say four words stand here now"), (9, mixed)]), bench).collect()}
    assert {k for k in got if k[0] not in (6, 9)} == {(1, 10), (2, 10), (7, 10), (8, 13)}
    assert got[1, 10].kind == "verbatim" and got[1, 10].coverage == 1.0
    assert got[2, 10].kind == "reparameterised" and got[2, 10].n_changed >= 3
    assert decontaminate.contaminated(docs(spark, []), bench).collect() == []
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).collect() == []


def test_decontamination_does_not_depend_on_letter_case(spark):
    item = "A train with Maria leaves at 10 km and drives 25 km before Maria stops for 10 minutes near the old station"
    small = "the old shop, the bakery, the school, the church and the mill sell apples, pears, nuts, plums and figs to every friend"
    mixed = item.replace("Maria", "Peter", 1).replace("Maria", "Oscar").replace("10 km", "70 km").replace("25 km", "31 km").replace("10 minutes", "9 minutes")
    rows = [(6, item.lower()), (9, mixed), (10, item.upper()), (11, "Then, " + small.upper()), (12, small.title()), (13, small), (14, "nothing of this kind")]
    bench = spark.createDataFrame([(10, item), (20, small)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert set(got) == {(6, 10), (9, 10), (10, 10), (11, 20), (12, 20), (13, 20)}
    assert {k: r.kind for k, r in got.items() if r.coverage == 1.0 and k != (9, 10)} == {k: "verbatim" for k in got if k != (9, 10)}
    assert (got[9, 10].kind, got[9, 10].n_slots, got[9, 10].n_changed) == ("reparameterised", 4, 4)


def test_decontamination_judges_every_occurrence(spark):
    say = "the old shop sells apples and pears for {} coins to each friend who comes by the station today while a cold wind blows over the wide empty square before noon".format
    item, partial = say(5), "the old shop sells apples and pears for 9 coins. then we read: "
    put_in = say(8).replace("comes by", "comes by on foot")
    rows = [(1, partial + item), (2, partial + say(7)), (3, say(7) + " " + partial), (4, partial + put_in), (5, partial), (6, (partial + say(7) + ". ") * 40),
            (7, partial), (7, "before. " + say(7))]
    bench = spark.createDataFrame([(20, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7}
    assert (got[1].kind, got[1].coverage) == ("verbatim", 1.0)
    assert {(got[i].kind, got[i].coverage, got[i].n_slots, got[i].n_changed) for i in (2, 3, 6, 7)} == {("reparameterised", 1.0, 1, 1)}
    assert got[4].kind == "reparameterised" and got[4].n_changed == 1 and 0.5 <= got[4].coverage < 1


def test_decontamination_finds_long_quotes(spark):
    w = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "qua") for b in ("ra", "so", "ti", "vu", "xe", "zor", "lin", "mab")]  # 48 words
    cut = lambda lo, n: "before this " + " ".join(w[lo:lo + n]) + " and after it"
    apart = " ".join([*w[5:17], "other", *w[18:29]])  # 12 and 11 words
    rows = [(1, cut(20, 13)), (2, cut(20, 12)), (3, cut(0, 20).upper()), (4, apart), (5, cut(35, 13)), (6, cut(0, 12) + " " + cut(30, 12))]
    bench = spark.createDataFrame([(20, " ".join(w)), (21, "one two three four five six")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert {i: (r.n_windows, r.item_windows, r.kind) for i, r in got.items()} == {1: (6, 41, "verbatim"), 3: (13, 41, "verbatim"), 5: (6, 41, "verbatim")}


# ------------------------------------------------------------------------------------------------ search
def brute_top(vectors, k):
    out = set()
    for q, a in vectors:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q and len(a) == len(b))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("scale", [1.0, 3e6])
def test_topk_equals_brute_force(spark, scale):
    rng = random.Random(5)
    rows = [(i, [scale * rng.choice([-0.5, 0.25, 0.3, 1.0, -1.0]) for _ in range(3)], i) for i in range(160)]
    rows += [(i, rows[0][1], 0) for i in range(1000, 1020)]  # ties
    bad = [(50_000, None, 0), (50_050, [1.0, None, 2.0], 0), (50_100, [float("nan"), 1.0, 1.0], 0), (50_150, [float("inf"), 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score int").repartition(5)
    vectors = topk.quantised(table)
    got = {tuple(r) for r in topk.search(vectors.where("vec_id % 50 = 0"), vectors, k=5, bins=16).collect()}
    assert got == brute_top([(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows], 5)


def test_topk_with_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 0.5])], "vec_id long, embedding array<double>")
    vectors = topk.quantised(table)
    assert {tuple(r) for r in topk.search(vectors.where("vec_id = 0"), vectors).collect()} == {(0, 1, 7, 256 * 128)}
    assert topk.search(vectors.limit(0), vectors).collect() == [] and topk.search(vectors.where("vec_id = 0"), vectors.where("vec_id = 0")).collect() == []


# ------------------------------------------------------------------------------------------------ models
def labelled(spark):
    rng = random.Random(2)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    one, two = "the and with house water morning green".split(), "der und mit haus wasser morgen grün".split()
    rows = [(i, say(one if i % 2 else two, 30), "en" if i % 2 else "de") for i in range(120)]
    return rows, say, one, two


def test_language_spans_and_odd_texts(spark):
    rows, say, one, two = labelled(spark)
    model = language.fit(spark.createDataFrame([(t, x) for _, t, x in rows] + [("x", None), (None, "en")], "text string, lang string"))
    assert model.languages == ["de", "en"]
    mixed = say(one, 20) + ". " + say(two, 25)
    odd = [(1, None), (2, ""), (3, "12 34 !"), (4, mixed), (5, say(two, 3000)), (6, "Привет мир"), (7, "½ ²"), (None, say(one, 9))]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs(spark, odd), model, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 0.0)
    assert got[4][0] == "de" and 0.5 < got[4][1] < 0.6 and got[5] == ("de", 1.0) and got[None][0] == "en"
    spans = sorted((r.start, r.end, r.lang) for r in language.spans(docs(spark, odd), model).where("doc_id = 4").collect())
    cut = mixed.index(". ")
    assert [x[2] for x in spans] == ["en", "de"] and abs(spans[0][1] - cut) < 8
    none = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language.predict(docs(spark, odd), none, ["doc_id"]).collect()} == {"und"}


def test_viterbi_equals_full_search():
    from itertools import product

    rng = np.random.default_rng(4)
    scores = rng.integers(-5, 1, (6, 3)).astype(np.float32)
    words, sizes = rng.integers(0, 6, 12), np.array([5, 0, 3, 4])
    got, at = language.viterbi(scores, words, sizes, 1.5), 0
    worth = lambda own, path: sum(scores[w, k] for w, k in zip(own, path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
    for n in sizes:
        own = words[at:at + n]
        assert worth(own, got[at:at + n]) == max((worth(own, p) for p in product(range(3), repeat=int(n))), default=0)
        at += n


def test_toxicity_is_learnt_from_document_labels(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "so", "ti", "vu", "xe")]
    text = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(6))
    rows = []
    for i in range(300):
        t = text()
        if bad := i % 4 == 0:
            t = t.replace(". ", f". {rng.choice(['grubby', 'vilest'])} ", 1)
        rows.append((t, int(bad)))
    model = toxicity.fit(spark.createDataFrame([*rows[:200], (None, 1), ("x", None)], "text string, toxic int"))
    held = docs(spark, [(i, t) for i, (t, _) in enumerate(rows[200:])] + [(900, None), (901, ""), (902, "?!"), (903, "ka " * 9000)])
    got = {r.doc_id: r.score for r in toxicity.score(held, model, ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and max(got[900], got[901], got[902]) < 0.3
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, (_, y) in enumerate(rows[200:])]) >= 0.97
    hits = toxicity.offending_sentences(held, model).collect()
    assert hits and all(("grubby" in s) or ("vilest" in s) for s in (rows[200 + h.doc_id][0][h.start:h.end] for h in hits if h.doc_id < 100))
    empty = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert {r.score for r in toxicity.score(held, empty, ["doc_id"]).collect()} == {0.5}
    assert toxicity.score(held.limit(0), model, ["doc_id"]).collect() == []


def test_ordinals_number_every_key(spark):
    df = common.stored(spark.createDataFrame([(i % 2 if i % 3 else 0, i) for i in range(500)], "k int, i long"))
    got = common.ordinals(df, "k", ["i"], rows_per_part=20).groupBy("k").agg(F.sort_array(F.collect_list("ordinal")).alias("o")).collect()
    assert all(list(r.o) == list(range(len(r.o))) for r in got) and len(got) == 2


def test_new_words_are_scored_together_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(4)
    written = rng.random((len(language.NAMES), 3)) < 0.6
    written[language.NAMES.index("thai")] = False  # a script of no language
    model = language.LanguageModel(["a", "b", "c"], rng.normal(-9, 3, (1 << 10, 3)), written)
    words = ["a", "\u00e9t\u00e9", "\u4e2d\u6587", "\u0e01\u0e02", "\u0431\u043e\u043b\u044c\u0448\u043e\u0439", "\U0001d400b", "\u02b0x", "x" * 5000, "ab", "aba"]
    want = np.array([model.word_scores(w) for w in words])
    monkeypatch.setattr(language, "SCORES_AT_ONCE", 60)  # several slices
    assert np.array_equal(model.scores_of(words, language.Grams(1 << 10)), want)
    assert model.scores_of([], language.Grams(1 << 10)).shape == (0, 3)
    monkeypatch.setattr(language.LanguageModel, "word_scores", None)  # no call for a single word
    label = language.Labeller(model)
    _, sizes = label([" ".join(words), "aba ab", ""])
    assert sizes.tolist() == [len(words), 2, 0]
    assert np.array_equal(label.table[[label.index[w.lower()] for w in words]], model.scores_of([w.lower() for w in words], language.Grams(1 << 10)))
