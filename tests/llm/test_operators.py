"""The operators against brute force on small tables with nulls, ties, repeats, long and empty texts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from spanledger.llm import common, decontam, exact_dedup, fixity, langid, packing, quality, simhash, suffix_dedup, token_bits, toxicity
from spanledger.llm import queries as llm_queries

DOCS = "doc_id long, text string"
EMPTY = "doc_id long, text string, lang string, score string, bucket string"
WORDS = "red blue green stone river tall small light dark wind open close".split()


def words(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, nulls, empty ones and a long one; ids out of order."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2 and rows:
            text = r.choice(rows)[1]
        elif kind < 0.35 and rows:
            text = (r.choice(rows)[1] or "") + " end"
        elif kind < 0.4:
            text = None
        elif kind < 0.45:
            text = r.choice(["", "  \n", "É"])
        else:
            text = words(r, r.randint(1, 120))
        rows.append((i * 7 % 101, text))
    rows.append((500, words(r, 5000)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "own") for x in rows], DOCS + ", bucket string").repartition(3)


# ---- 1 ----


def test_language_learns_and_says_und(spark):
    r = random.Random(3)
    en, fr = "the of and to in that".split(), "le la des une que dans".split()
    rows = [(i, " ".join(r.choice(en if i % 2 else fr) for _ in range(30)), "en" if i % 2 else "fr") for i in range(200)]
    rows += [(900, None, "en"), (901, "12 34 !", "en"), (902, "", None), (903, "the of " * 300_000, None)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    got = {x.doc_id: x for x in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == rows[i][2] for i in range(200))
    assert [got[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert got[900].score == 0 and all(0 <= x.score <= 1 for x in got.values())
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got.values())


def test_language_pieces_do_not_change_the_sums(monkeypatch):
    matrix = np.random.default_rng(1).random((2, langid.COLUMNS + 1)).astype(np.float32)
    texts = ["Abc def", None, "", "x" * 57, "é ü" * 11]
    whole = langid.log_odds(texts, matrix)
    monkeypatch.setattr(langid, "PIECE", 13)
    cut = langid.log_odds(texts, matrix)
    assert np.allclose(whole[0], cut[0]) and (whole[1] == cut[1]).all()


def brute_bayes(rows, bits):
    """Plain multinomial naive Bayes over the n-grams of every text: (language, posterior) by text."""
    def grams(text):
        own = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + "  "
        points = np.frombuffer(own.encode("utf-32-le"), "<u4")
        return [int(c) for part in langid.hashed(points, bits) for c in part if c != 1 << bits]

    names = sorted({g for _, _, g in rows})
    counts = {k: np.full(1 << bits, 0.05) for k in names}
    for _, text, g in rows:
        for c in grams(text):
            counts[g][c] += 1
    n = {k: sum(1 for *_, g in rows if g == k) for k in names}

    def predict(text):
        at = grams(text)
        total = np.array([np.log(n[k] / len(rows)) + np.log(counts[k][at] / counts[k].sum()).sum() for k in names])
        odds = np.exp(total - total.max())
        return names[int(total.argmax())], odds.max() / odds.sum()

    return predict


def test_language_equals_plain_naive_bayes(spark):
    r = random.Random(7)
    kinds = {"aa": "ab ac ad bé".split(), "bb": "ab ba bb cé".split(), "cc": "ab ca cb dé".split()}
    rows = [(i, " ".join(r.choice(kinds[k]) for _ in range(r.randint(1, 6))), k) for i, k in enumerate(r.choice(list(kinds)) for _ in range(90))]
    learn = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5]
    predict = brute_bayes(learn, langid.BITS)
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, DOCS + ", lang string")).collect()}
    for i, text, _ in rows:
        name, score = predict(text)
        assert got[i].lang_pred == name and abs(got[i].score - score) < 1e-3


def test_language_of_an_empty_table(spark):
    assert langid.identify(spark.createDataFrame([], EMPTY)).collect() == []


def test_language_of_repeats_null_ids_ties_and_clashing_names(spark, monkeypatch):
    rows = [(None, "le la", None, "own"), (1, "the of", "en", "own"), (1, "the of", "en", "own"), (2, "le la", "fr", "own"), (3, "zz", None, "own")]
    docs = spark.createDataFrame(rows, DOCS + ", lang string, found string")
    names, prior, matrix = langid.train(docs)
    got = langid.predict(docs.withColumn("score", F.lit("old")), names, prior, matrix).collect()
    assert len(got) == 5 and {x.found for x in got} == {"own"} and {x.lang_pred for x in got if x.doc_id == 1} == {"en"}
    assert all(isinstance(x.score, float) for x in got)
    even = langid.predict(docs, ["b", "c"], np.zeros(2), np.zeros((2, 65), np.float32)).collect()
    assert {(x.lang_pred, x.score) for x in even} == {("b", 0.5)}


def test_language_of_very_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 1 << 16)
    monkeypatch.setattr(langid, "TABLE", 1000)
    assert langid.bits_for(4) == 14 and langid.bits_for(600) == 6 and langid.bits_for(1) == langid.BITS
    rows = [(i, f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i)}", f"l{i:04}") for i in range(600)]
    names, prior, matrix = langid.train(spark.createDataFrame(rows, DOCS + ", lang string"))
    assert len(names) == 600 and matrix.shape == (600, 65)
    got = langid.predict(spark.createDataFrame(rows[:5], DOCS + ", lang string"), names, prior, matrix).collect()
    assert len(got) == 5 and all(x.lang_pred in set(names) for x in got)


# ---- 2 ----


def audited(spark, left, right):
    schema = "page_id long, url string, html string"
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    sides = [fixity.leaves(spark.createDataFrame(x, schema), "page_id", record) for x in (left, right)]
    return {x.node: x for x in fixity.audit(*sides).collect()}


def test_fixity_finds_every_fault(spark):
    left = [(i * 5, f"u{i}", "h" * i) for i in range(300)] + [(7000, None, None), (7001, "", "")]
    right = [x for x in left if x[0] not in (10, 1495)]
    right = [(a, b, c + "x" if a in (5, 700) else c) for a, b, c in right] + [(3, "new", "page")]
    got = audited(spark, left, right)
    assert {k: v.status for k, v in got.items()} == {10: "missing", 1495: "missing", 5: "altered", 700: "altered", 3: "extra"}
    size = lambda p, u, h: len(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{p}>\r\nWARC-Target-URI: {u}\r\nContent-Type: text/html\r\nContent-Length: {len(h)}\r\n\r\n{h}\r\n\r\n")
    for key in (10, 700, 1495):
        assert got[key].start == sum(size(*x) for x in left if x[0] < key)
    assert audited(spark, left, left) == {}


def test_fixity_of_repeated_null_and_negative_numbers(spark):
    left = [(1, "a", "x"), (1, "a", "x"), (None, "n", "n"), (-4, "m", "m")]
    assert audited(spark, left, left) == {}
    assert set(audited(spark, left, left[1:])) == {1}
    assert set(audited(spark, left, [*left[:2], left[3]])) == {fixity.NO_KEY}
    assert audited(spark, [], []) == {} and set(audited(spark, [], left[:1])) == {1}


# ---- 3 ----


def test_boundaries_are_optimal():
    from itertools import combinations

    r = np.random.default_rng(2)
    for _ in range(40):
        n = int(r.integers(1, 9))
        lengths = np.sort(r.choice(np.arange(1, 60), n, replace=False))
        counts = r.integers(1, 20, n)
        k = int(r.integers(1, 5))

        def padding(bounds):
            return sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts, strict=True))

        best = min(padding([*c, lengths[-1]]) for m in range(min(k, n)) for c in combinations(lengths[:-1], m))
        assert padding(packing.boundaries(lengths, counts, k)) == best


def test_boundaries_are_optimal_beside_the_budget_and_for_long_texts():
    from itertools import combinations

    r = np.random.default_rng(3)
    for _ in range(60):
        n = int(r.integers(2, 9))
        lengths = np.sort(r.choice(np.arange(4000, 9000), n, replace=False))
        counts, k, budget = r.integers(1, 20, n), int(r.integers(1, 5)), int(r.integers(4000, 9000))
        fit = [int(x) for x in lengths if x <= budget]
        forced = fit[-1:] if fit and len(fit) < n else []

        def padding(bounds):
            return sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts, strict=True))

        k = max(k, 1 + len(forced))
        every = [sorted({*c, *forced, int(lengths[-1])}) for m in range(min(k, n)) for c in combinations(lengths[:-1].tolist(), m)]
        best = min(padding(b) for b in every if len(b) <= k)
        got = packing.boundaries(lengths, counts, k, budget)
        assert padding(got) == best and set(forced) <= set(got) and len(got) <= k
    lengths = np.arange(1, 40_001)
    got = packing.boundaries(lengths, np.ones(40_000, int), 16, 32_768)
    assert 32_768 in got and got[-1] == 40_000 and len(got) == 16


def test_packing_of_null_ids_ties_and_clashing_names(spark):
    rows = [(None, "a b", 1, 2, 3), (None, "a b", 1, 2, 3), (None, None, 1, 2, 3), (4, "c", 1, 2, 3), (4, "c d e f g", 1, 2, 3)]
    docs = spark.createDataFrame(rows, DOCS + ", n_tokens int, bucket int, place int")
    got = packing.pack(docs, packing.n_words(F.col("text")), buckets=2, budget=4).collect()
    assert sorted(x.n_tokens for x in got) == [0, 1, 2, 2, 5] and len({(x.batch_id, x.slot) for x in got}) == 5
    assert {x.bucket_len for x in got} == {2, 5}
    nulls = packing.pack(docs, F.lit(None).cast("long")).collect()
    assert {(x.n_tokens, x.bucket_len) for x in nulls} == {(0, 1)}


def test_packing_places_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 7)
    rows = corpus(4)
    got = packing.pack(frame(spark, rows), packing.n_words(F.col("text")), buckets=4, budget=200).collect()
    assert sorted((x.doc_id, x.n_tokens) for x in got) == sorted((d, len((t or "").split())) for d, t in rows)
    assert len({(x.batch_id, x.slot) for x in got}) == len(got)
    batches = {}
    for x in got:
        batches.setdefault(x.batch_id, []).append(x)
        assert x.padding == x.bucket_len - x.n_tokens >= 0
    assert sorted(batches) == list(range(len(batches)))
    for own in batches.values():
        assert len({x.bucket for x in own}) == 1 and (len(own) == 1 or len(own) * own[0].bucket_len <= 200)
    for bucket in {x.bucket for x in got}:  # all batches of a bucket but one are full
        sizes = sorted(len(b) for b in batches.values() if b[0].bucket == bucket)
        assert all(s == max(1, 200 // next(x.bucket_len for x in got if x.bucket == bucket)) for s in sizes[1:])
    assert packing.pack(spark.createDataFrame([], EMPTY), packing.n_words(F.col("text"))).collect() == []


# ---- 4 ----


def brute_suffix(docs):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                hit[i : i + 100] = b"\1" * 100
            else:
                seen.add(b[i : i + 100])
        kept = bytes(x for x, c in zip(b, hit, strict=True) if not c)
        spans = sum(1 for i in range(len(hit)) if hit[i] and (i == 0 or not hit[i - 1]))
        out[d] = (len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_rows_are_placed_between_edges_column_by_column():
    r = np.random.default_rng(4)
    rows = r.integers(0, 3, (400, 4))
    edges = np.array(sorted(map(tuple, r.integers(0, 3, (30, 4)))))
    got = suffix_dedup.below(edges, rows)
    assert got.tolist() == [sum(tuple(e) <= tuple(row) for e in edges) for row in rows]
    assert suffix_dedup.below(np.zeros((0, 4), np.int64), rows).tolist() == [0] * 400


@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    r = random.Random(piece)
    common, line = "".join(r.choice("abc é") for _ in range(260)), "".join(r.choice("xyz") for _ in range(80))
    docs = [(None, common), (-1, None), (-2, ""), (-3, "ab" * 300)]
    for i in range(70):
        noise = lambda n: "".join(r.choice("abcdefg \n") for _ in range(n))
        kind = r.random()
        if kind < 0.3:
            text = noise(r.randint(0, 120)) + common[r.randint(0, 150) :] + noise(40)
        elif kind < 0.5:
            text = noise(60) + line + noise(60)
        elif kind < 0.7:
            text = r.choice(docs)[1]
        else:
            text = noise(r.randint(0, 900))
        docs.append((i * 3, text))
    got = {x[0]: tuple(x)[1:5] for x in suffix_dedup.suffix_dedup(frame(spark, docs)).collect()}
    assert got == brute_suffix(docs)


def test_suffix_dedup_of_repeated_rows_and_nothing(spark):
    rows = [(1, "q" * 150), (1, "q" * 150), (2, "w" * 99)]
    got = sorted(tuple(x)[:4] for x in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())
    assert got == [(1, 150, 149, 1)] * 2 + [(2, 99, 0, 0)] or got == [(1, 150, 149, 1), (1, 150, 149, 1), (2, 99, 0, 0)]
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], EMPTY)).collect() == []


def test_suffix_dedup_searches_every_text_of_repeated_and_null_ids(spark):
    r = random.Random(44)
    noise = lambda n: "".join(r.choice("abcdefg \n") for _ in range(n))
    common, docs = noise(400), []
    for i in range(60):
        text = noise(r.randint(0, 300)) + r.choice(["", common[r.randint(0, 250) :]]) + noise(30)
        docs.append((None if i % 3 == 0 else r.randint(0, 12) - 3, text))
    docs += [(None, docs[1][1]), (4, docs[0][1]), (None, None), (-(1 << 63), common), docs[5], docs[6]]
    key = lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256((x[1] or "").encode()).hexdigest())
    once = {key(x): x for x in docs}
    order = sorted(once)
    brute = brute_suffix([(n, once[k][1]) for n, k in enumerate(order)])
    want = [(x[0], *brute[order.index(key(x))]) for x in docs]
    got = [tuple(x) for x in suffix_dedup.suffix_dedup(frame(spark, docs)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


# ---- 5 ----


def shingles(text, size):
    w = [x for x in re.split(r"[^\w]|_", (text or "").lower()) if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}, len(w)


def test_containment_equals_brute_force(spark, monkeypatch):
    r = random.Random(8)
    items = [(i, words(r, r.randint(1, 40))) for i in range(25)] + [(90, None), (91, "..."), (3, words(r, 12))]
    docs = corpus(9, 40)
    for k in range(40):
        one = r.choice(items[:25])[1].split()
        for _ in range(r.randint(0, 2)):
            one[r.randrange(len(one))] = "changed"
        docs.append((1000 + k, words(r, r.randint(0, 200)) + "\n" + " , ".join(one).upper() + " " + words(r, 50)))
    docs += [docs[-1], (None, items[0][1]), (None, words(r, 30)), (1000, items[1][1]), (1000, None)]
    want = set()
    grouped = {}
    for i, t in items:
        n = shingles(t, 1)[1]
        if n:
            grouped.setdefault(i, set()).update(shingles(t, min(n, 5))[0])
    want = []
    for d, t in set(docs):
        there = set().union(*(shingles(t, s)[0] for s in range(1, 6)))
        want += [(d, i, len(g), len(g & there)) for i, g in grouped.items() if len(g & there) >= 0.8 * len(g) - 1e-9]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x)[:4] for x in decontam.contained(frame(spark, docs), table).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 20
    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(common.fits, "__defaults__", (0, 0))
    got = [tuple(x)[:4] for x in decontam.contained(frame(spark, docs), table).collect()]  # nothing is broadcast
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_signatures_are_partitioned_by_size(spark):
    r = random.Random(18)
    items = [(i, words(r, r.randint(1, 60))) for i in range(40)] + [(50 + i, "the same first words of all " + words(r, 9)) for i in range(10)]
    wanted = decontam.item_shingles(spark.createDataFrame(items, "item_id long, text string"))
    sets = {}
    for x in wanted.collect():
        sets.setdefault(x.item_id, set()).add(x.shingle)
    got = decontam.signatures(wanted).collect()
    for i, own in sets.items():
        rows, n = [x for x in got if x.item_id == i], len(own)
        need = math.ceil(0.8 * n - 1e-9)
        assert {(x.n, x.need, x.k) for x in rows} == {(n, need, n - need + 1)} and len({x.h for x in rows}) == n - need + 1
    common_first = {x.shingle for x in wanted.where("item_id >= 50").groupBy("shingle").count().where("count = 10").collect()}
    hashes = {x.h for x in spark.createDataFrame([(c,) for c in common_first], "s string").select(F.xxhash64("s").alias("h")).collect()}
    assert hashes and not hashes & {x.h for x in got}  # what items share does not stand for them while they have more


def test_containment_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained(frame(spark, corpus()), items).collect() == []
    full = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contained(spark.createDataFrame([], EMPTY), full).collect() == []


# ---- 6 and 10 ----


def test_quality_ranks_junk_below_prose(spark):
    r = random.Random(5)
    rows = [(i, words(r, 80) + "." if i % 3 else "!! ".join(words(r, 60).upper().split())) for i in range(300)]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(300)] + [(5000, 1), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], DOCS)
    got = {x.doc_id: x for x in quality.quality(docs, labels).collect()}
    assert len(got) == 302 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values())
    assert np.mean([got[i].predicted == (1 if i % 3 else 0) for i in range(300) if got[i].held_out]) > 0.95
    again = {x.doc_id: x.score for x in quality.quality(docs.repartition(5), labels).collect()}
    assert all(abs(again[k] - v.score) < 1e-9 for k, v in got.items())


def test_quality_is_a_minimum_of_the_pairwise_loss():
    r = np.random.default_rng(4)
    rows = r.normal(size=(160, 3)).astype(np.float32)
    label = (rows[:, 0] + 0.6 * r.normal(size=160) > 0).astype(int)
    model = quality.fit(rows, label, np.ones(160))
    x = quality.expand(rows, model["edges"])

    def loss(w):
        f = x @ w
        differences = f[label == 1][:, None] - f[label == 0][None, :]
        return float(np.log1p(np.exp(-differences)).mean() + 0.5e-4 * (w @ w))

    own = loss(model["w"])
    assert own < 0.6 * loss(np.zeros_like(model["w"]))
    slope = np.array([(loss(model["w"] + e) - loss(model["w"] - e)) / 2e-4 for e in np.eye(len(model["w"])) * 1e-4])
    assert np.abs(slope).max() < 0.02  # steps are stochastic: close to where the gradient ends
    z = model["scale"] * (x @ model["w"] - model["cut"]) + np.log(0.7 / 0.3)
    share = (label == 0).mean()
    assert abs((1 / (1 + np.exp(-z)) < 0.7).mean() - share) < 0.02  # the threshold is the quantile of the share marked 0


def test_features_of_parts_are_those_of_the_whole(monkeypatch):
    r = random.Random(71)
    text = "\n".join(words(r, r.randint(0, 9)) + r.choice(["", " É!", " AB", "\t"]) for _ in range(300))
    whole = quality.features(text), simhash.fingerprint(text)
    monkeypatch.setattr(quality, "LONG", 100)
    monkeypatch.setattr(simhash, "LONG", 100)
    assert np.allclose(quality.features(text), whole[0], rtol=1e-5) and simhash.fingerprint(text) == whole[1]


def test_quality_of_repeats_clashing_names_and_long_texts(spark):
    r = random.Random(72)
    rows = [(i, words(r, 40) + "." if i % 2 else "!! ".join(words(r, 40).upper().split())) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, "own") for i in range(120)] * 2, "doc_id long, quality int, text string")
    more = [(200, words(r, 300_000) + "."), (1, rows[1][1]), (None, rows[1][1])]
    docs = spark.createDataFrame([(*x, "old", "own") for x in rows + more], DOCS + ", score string, label string")
    model = quality.train(docs, labels)
    got = quality.rate(docs, model).collect()
    assert len(got) == 123 and {x.label for x in got} == {"own"} and all(isinstance(x.score, float) for x in got)
    assert len({x.score for x in got if x.text == rows[1][1]}) == 1
    bounded = common.labelled_texts(docs, labels, "quality", F.lit(True), 1000, 4000).collect()
    assert 5 < len(bounded) < 120 and sum(len(x.text) for x in bounded) <= 4000 and abs(sum(x.weight for x in bounded) - 120) < 1e-6


def test_quality_learns_from_every_label(spark, monkeypatch):
    rng = random.Random(3)
    words = lambda good: " ".join(rng.choice(["stone", "river", "walks"] if good else ["XX", "!!", "9"]) + str(rng.randrange(50)) for _ in range(12))
    rows = [(k, words(k % 4 > 0)) for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k, _ in rows] + [(3, None), (4, 7), (None, 1)], "doc_id long, quality int")
    kept = quality.labelled(docs, labels, common.fold(4) != 2)
    own = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 != 2}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == own and kept.count() == len(own)
    monkeypatch.setattr(quality, "STEPS", 60)
    monkeypatch.setattr(quality, "GROUP_ROWS", 2000)
    monkeypatch.setattr(quality, "CUT_ROWS", 8)
    model = quality.train(docs, labels)
    x = np.array([r.x for r in kept.orderBy("doc_id").collect()], np.float32)
    raw, bad = np.sort(quality.expand(x, model["edges"]) @ model["w"]), sum(k % 4 == 0 for k in own)
    assert np.isclose(model["cut"], (raw[bad - 1] + raw[bad]) / 2) and np.isclose(model["scale"], 4 / raw.std())
    got = quality.train(docs.repartition(7), labels)
    assert got["cut"] == model["cut"] and (got["w"] == model["w"]).all()


def test_quality_with_one_class_or_no_labels(spark):
    some = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    one = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    assert {x.score for x in quality.quality(one, some).collect()} == {1.0}
    docs, none = spark.createDataFrame([(1, "a"), (2, None)], DOCS), spark.createDataFrame([], "doc_id long, quality int")
    assert {x.score for x in quality.quality(docs, none).collect()} == {0.5}
    assert quality.quality(spark.createDataFrame([], EMPTY), none).collect() == []


def test_toxicity_finds_documents_and_sentences(spark):
    r = random.Random(6)
    rows = []
    for i in range(600):
        sentences = [words(r, 8) for _ in range(6)]
        if i % 4 == 0:
            sentences[3] += " vile"
        rows.append((i, ". ".join(sentences) + "."))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    docs = spark.createDataFrame([*rows, (900, None), (901, "...")], DOCS)
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    for i in held:
        if got[i].predicted and i % 4 == 0:
            assert "vile" in rows[i][1][got[i].worst_start : got[i].worst_end]
    assert got[900].score == got[901].score == 0 and got[900].worst_start == -1
    assert toxicity.toxicity(spark.createDataFrame([], EMPTY), labels).collect() == []


def plain_noisy_or(text, weights, bias):
    """Noisy-or over sentences, word by word."""
    clean, worst = 1.0, 0.0
    for sentence in re.split(r"(?<=[.!?])\S*\s+|\n", (text or "").lower()):
        found = re.findall(r"[^\W\d_]+", sentence)
        if found:
            z = bias + sum(weights.get(c, 0.0) for w in found for c in toxicity.columns_of(w))
            p = 1 / (1 + math.exp(-z))
            clean, worst = clean * (1 - p), max(worst, p)
    return 1 - clean, worst


def test_toxicity_scores_are_the_noisy_or_of_sentences(monkeypatch):
    r = random.Random(73)
    weights = {toxicity.column(w): v for w, v in (("red", 1.0), ("river", 2.5), ("^rive", 0.7), ("stone", -1.5), ("É".lower(), 2.0))}
    texts = [". ".join(words(r, r.randint(0, 9)) for _ in range(r.randint(0, 8))) + r.choice([".", "", "\n", "! É"]) for _ in range(60)] + [None, "...", "7 8", "a.b c"]
    want = [plain_noisy_or(t, weights, -4.0) for t in texts]
    model = {"columns": list(weights), "w": list(weights.values()), "bias": -4.0}
    for long, piece, cache in ((1 << 20, 1 << 18, 1 << 19), (40, 1 << 18, 1 << 19), (1 << 20, 30, 20), (40, 30, 20)):
        monkeypatch.setattr(toxicity, "LONG", long)
        monkeypatch.setattr(toxicity, "PIECE", piece)
        monkeypatch.setattr(toxicity, "CACHE", cache)
        got = toxicity.Judge(model).batch(texts)
        assert np.allclose([x[0] for x in got], [x[0] for x in want]) and np.allclose([x[3] for x in got], [x[1] for x in want])


def test_toxicity_significance_equals_plain_counting(spark):
    r = random.Random(74)
    rows = [(r.randint(0, 30), r.randint(0, 70)) for _ in range(50)]
    rows = [(h, h + k) for h, k in rows]
    table = spark.createDataFrame(rows, "hits long, rows long")
    got = [x[0] for x in table.select(toxicity.ratio(F.col("hits"), F.col("rows"), 30, 100)).collect()]
    for (h, k), g in zip(rows, got, strict=True):
        cells = [[h, k - h], [30 - h, 70 - k + h]]
        want = sum(2 * cells[i][j] * math.log(cells[i][j] * 100 / (sum(cells[i]) * (cells[0][j] + cells[1][j]))) for i in (0, 1) for j in (0, 1) if cells[i][j])
        assert abs(g - want) < 1e-6


def test_toxicity_without_labels_with_one_class_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b. c", "own"), (1, "a b. c", "own"), (None, "d", "own"), (2, None, "own"), (3, "x " * 700_000, "own")], DOCS + ", judged string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(x.score, x.predicted) for x in toxicity.toxicity(docs, none).collect()} == {(0.0, 0)}
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0)], "doc_id long, toxic int")
    assert {(x.score, x.predicted) for x in toxicity.toxicity(docs, one).collect()} == {(1.0, 1)}
    clean = spark.createDataFrame([(1, 0), (1, None)], "doc_id long, toxic int")
    assert {(x.score, x.predicted) for x in toxicity.toxicity(docs, clean).collect()} == {(0.0, 0)}
    got = toxicity.rate(docs, {"columns": [toxicity.column("x")], "w": [0.1], "bias": -3.0}).collect()
    assert len(got) == 5 and {x.judged for x in got} == {"own"} and [x.predicted for x in got if x.doc_id == 3] == [1]


# ---- 7 ----


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, f"{p:016x}", least[top(i)]) for i, (d, p) in enumerate(prints))


def test_simhash_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 3)
    r = random.Random(11)
    rows = corpus(12, 50)
    long = words(r, 900).split()
    for k in range(30):
        own = [*long]
        own[r.randrange(900)] = f"w{k}"
        rows.append((2000 + k, " ".join(own)))
    rows += [rows[-1], (3000, "ÀB c"), (3001, "àb c"), (3002, "a b c d e")]
    got = sorted(tuple(x) for x in simhash.near_groups(frame(spark, rows)).collect())
    assert got == brute_groups(rows)
    assert simhash.near_groups(spark.createDataFrame([], EMPTY)).collect() == []


def test_simhash_of_null_ids(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (None, "q w"), (None, None), (3, "")]
    got = sorted(((x.doc_id, x.component_id) for x in simhash.near_groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 7), (None, 7), (7, 7), (None, None), (None, 3), (3, 3)], key=str)


def test_simhash_walk_and_layouts_miss_no_link():
    r = np.random.default_rng(1)
    for _ in range(8):
        values = set()
        for b in r.integers(0, 2**63, 5, dtype=np.uint64):
            for _ in range(40):
                x = int(b)
                for k in r.integers(0, 64, r.integers(0, 6)):
                    x ^= 1 << int(k)
                values.add(x)
        v = np.array(sorted(values), np.uint64)
        want = np.arange(len(v))
        simhash.forest(len(v), want, *np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4))
        assert (simhash.walk(v, np.array([[0, len(v), 0, len(v)]])) == want).all()
        for count in (len(v), 10**7, 10**10):
            got = np.arange(len(v))
            for lead, order in simhash.layouts(count):
                turned = simhash.rotate(v, order)
                o = np.argsort(turned)
                head = turned[o] >> np.uint64(64 - lead)
                start = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
                end = np.r_[start[1:], len(head)]
                pairs = np.stack([start, end, start, end], 1)[end - start > 1]
                labels = simhash.walk(turned[o], pairs)
                child = np.flatnonzero(labels != np.arange(len(labels)))
                simhash.forest(len(v), got, o[child], o[labels[child]])
            assert (got == want).all()


# ---- 8 ----


def brute_exact(rows, digest=lambda t: t):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (d, _), n in zip(rows, norm, strict=True):
        own = [x for x, m in zip(rows, norm, strict=True) if m == n]
        keep = sorted(own, key=lambda x: (-len(x[1] or ""), x[0]))[0][0]
        out.append((d, keep, len(own), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_equals_brute_force(spark, weak):
    rows = [*corpus(21), (700, "a b"), (701, "ab "), (702, "ab"), (703, "ab "), (500, "ab")]
    digest = (lambda c: F.left(exact_dedup.sha256(c), F.lit(1))) if weak else exact_dedup.sha256
    got = sorted(tuple(x) for x in exact_dedup.exact_dedup(frame(spark, rows), digest).collect())
    assert got == brute_exact(rows)


def test_exact_dedup_goes_on_from_its_state_and_checks_bytes(spark, tmp_path):
    schema = "digest string, doc_id long, locator long, n_points int, body string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{rows[0][2]}"))
        stream = spark.readStream.schema("digest string, doc_id long, locator long, n_points int").parquet(str(tmp_path / "in/*"))
        content = spark.read.schema(schema).parquet(str(tmp_path / "in/*")).select("digest", "locator", "body")
        exact_dedup.fold_stream(stream, content, str(tmp_path / "state"), str(tmp_path / "out"))
        state = {x.digest: (-x.keep.place, x.n_rows) for x in exact_dedup.current_state(spark, str(tmp_path / "out")).collect()}
        return state, {x.digest for x in exact_dedup.mixed_digests(spark, str(tmp_path / "out")).collect()}

    assert run([("a", 5, 50, 10, "aa"), ("b", 6, 60, 3, "bb")]) == ({"a": (50, 1), "b": (60, 1)}, set())
    assert run([("a", 4, 40, 10, "aa"), ("b", 9, 90, 3, "other")]) == ({"a": (40, 2), "b": (60, 2)}, {"b"})
    assert run([("a", 1, 41, 11, "ab"), ("c", 9, 91, 3, "cc")]) == ({"a": (41, 3), "b": (60, 2), "c": (91, 1)}, {"a", "b"})


def test_exact_dedup_of_nothing_and_of_null_and_repeated_ids(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], EMPTY)).collect() == []
    rows = [(None, "x y"), (4, "xy "), (4, "xy "), (None, "p q"), (None, "pq "), (None, "p  q"), (8, None), (8, ""), (9, "z" * 2_000_000)]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert sorted((x.keep_id, x.group_size, x.kept) for x in got if x.keep_id is not None) == sorted([(4, 3, False)] * 2 + [(4, 3, True)] + [(8, 2, True), (8, 2, False), (9, 1, True)])
    assert sorted((x.doc_id, x.group_size, x.kept) for x in got if x.keep_id is None) == [(None, 3, False)] * 2 + [(None, 3, True)]


def test_exact_dedup_carries_columns_and_ignores_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "d1", 10), (2, "a ", "d2", 20)], DOCS + ", digest string, number int")
    got = sorted((x.number, x.kept) for x in exact_dedup.exact_dedup(docs, carry=["number"]).collect())
    assert got == [(10, False), (20, True)]
    weak = exact_dedup.exact_dedup(docs, lambda c: F.lit("one"), carry=["number"]).collect()
    assert sorted((x.number, x.kept) for x in weak) == got


# ---- 9 ----


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bits_round_trip():
    r = np.random.default_rng(7)
    for bits in (1, 5, 8, 11, 16, 17, 24, 31, 32):
        ids = r.integers(0, 2**bits, 1003, dtype=np.uint64).astype(np.uint32)
        data = token_bits.pack(ids, bits)
        assert len(data) == (1003 * bits + 7) // 8
        for start, stop in ((0, 1003), (0, 0), (7, 8), (501, 777), (1002, 1003)):
            assert (token_bits.unpack(data, bits, start, stop) == ids[start:stop]).all()
        block = token_bits.Block.read(token_bits.Block.of(bits, [4, 4, 9], [ids[:10], ids[10:10], ids[10:]]).tobytes())
        assert block.doc_ids.tolist() == [4, 4, 9] and (block.ids(2) == ids[10:]).all() and len(block.ids(1)) == 0
    with pytest.raises(ValueError):
        token_bits.Block.read(b"nope" + bytes(40))


def test_encoder_equals_the_tokenizer():
    coder = token_bits.Encoder(token_bits._contents(tokenizer_path()))
    texts = ["Hello, World! it's 42", "É cole naïve", "é x", "<|endoftext|> a<|startoftext|>b", "a\x1cb", "İstanbul Σς", "日本語 text", "", " \n\t", "snake_case __ x²½", "don't WE'LL 'tis", " wide space", "ß ŉ ſ"]
    for text in texts:
        assert coder.ids(text).tolist() == [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_encoder_of_any_other_tokenizer_file(monkeypatch):
    import json

    contents = token_bits._contents(tokenizer_path())
    assert token_bits.splits_at_white_space(json.loads(contents))
    spec = json.loads(contents)
    spec["normalizer"] = None
    coder = token_bits.Encoder(json.dumps(spec))
    other = token_bits.Encoder(token_bits._contents(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")))
    assert not coder.by_chunk and not other.by_chunk
    for text in ("Hello  World", "It's É", ""):
        for own in (coder, other):
            assert own.ids(text).tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, 1]
    whole = token_bits.Encoder(contents)
    monkeypatch.setattr(token_bits, "LONG", 3)
    assert token_bits.Encoder(contents).ids("a long text in parts").tolist() == [*whole.tokenizer.encode("a long text in parts", add_special_tokens=False).ids, 1]


def test_token_bits_of_null_and_repeated_ids(spark):
    rows = [(None, "b a"), (None, "c"), (None, None), (5, "x y z"), (5, "q"), (5, "q"), (-3, "")]
    want = None
    for parts in (1, 3, 5):
        docs = spark.createDataFrame([(*x, "own") for x in rows], DOCS + ", hash string").repartition(parts)
        got = sorted((tuple(x)[:4] for x in token_bits.token_bits(docs, tokenizer_path()).collect()), key=lambda x: x[1])
        assert [x[0] for x in got] == [None, None, None, -3, 5, 5, 5]
        want = want or got
        assert got == want


def test_token_bits_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_bits, "CACHE", 50)
    coder = token_bits.Encoder(token_bits._contents(tokenizer_path()))
    rows = corpus(31)
    token_bits.write(frame(spark, rows), str(tmp_path / "t"), tokenizer_path(), block_ids=300)
    got = sorted(tuple(x)[:4] for x in token_bits.read(spark, str(tmp_path / "t")).collect())
    at, want = 0, []
    for d, t in sorted(rows, key=lambda x: x[0]):
        ids = [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert spark.read.parquet(str(tmp_path / "t")).count() > 4
    assert token_bits.token_bits(spark.createDataFrame([], EMPTY), tokenizer_path()).collect() == []


# ---- queries and pipeline ----


def test_every_operator_has_its_query():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in llm_queries.queries()] == list(range(1, 14))
    assert set(llm_queries.oracle_sql()) <= set(llm_queries.queries())


def test_pipeline_decides_as_brute_force_does(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(41)
    good = [(i, words(r, 60) + ".") for i in range(120)]
    junk = [(200 + i, "!! ".join(words(r, 60).upper().split())) for i in range(60)]
    item = words(r, 20)
    extra = [(300, good[0][1] + "  "), (301, good[1][1]), (302, words(r, 40) + " " + item + " " + words(r, 30) + ".")]
    rows = good + junk + extra
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS + ", lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d < 200)) for d, _ in good + junk], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quality.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    kept = [x for x in rows if quality.score(model, [x[1]])[0] >= 0.7]
    kept = [x for x in kept if x[0] in {k for _, k, *_ in brute_exact(kept)}]
    kept = [x for x in kept if x[0] in {c for *_, c in brute_groups(kept)}]
    need = shingles(item, 5)[0]
    kept = [x for x in kept if len(need & shingles(x[1], 5)[0]) < 0.8 * len(need)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.n_tokens) for x in got) == sorted((d, len(t.split())) for d, t in kept)
    ids = {x.doc_id for x in got}
    assert 300 in ids and not ids & {0, 301, 302} and len(ids & set(range(120))) == 119


def test_pipeline_near_copies_are_decided_by_row(spark):
    import corpus_pipeline

    r = random.Random(45)
    t, u, v, w = (words(r, 60) for _ in range(4))
    rows = [(3, t), (None, t + " "), (5, t + "  "), (5, u), (None, v), (None, v + " "), (None, w), (7, w + " "), (9, None), (9, "")]
    groups = brute_groups(list(enumerate(x[1] for x in rows)))
    assert len({c for *_, c in groups}) == 5
    got = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()
    assert sorted((str(x.doc_id), (x.text or "").strip(), x.bucket) for x in got) == sorted([("3", t, "own"), ("5", u, "own"), ("None", v, "own"), ("7", w, "own"), ("9", "", "own")])


def test_pipeline_leaks_are_decided_by_row(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(46)
    item, clean = words(r, 20), [words(r, 40) for _ in range(4)]
    half = item.split()
    parts = [" ".join(half[:12]), " ".join(half[8:])]
    rows = [(None, f"{clean[0]} {item}"), (None, clean[1]), (5, f"{item} {clean[2]}"), (5, clean[3]), (6, parts[0]), (6, parts[1]), (7, None)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.drop_leaks(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted(map(str, ((x.doc_id, x.text, x.bucket) for x in got))) == sorted(str((*rows[i], "own")) for i in (1, 3, 4, 5, 6))


def test_pipeline_of_nulls_repeats_odd_names_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(47)
    text, other = words(r, 60) + ".", words(r, 60) + "."
    rows = [(None, text), (None, text + " "), (1, text), (1, other), (None, None), (2, ""), (3, other + " x")]
    schema = "doc_id long, text string, number string, row string, `a.b` string, digest string, score string"
    docs = spark.createDataFrame([(*x, "n", "r", "ab", "d", "s") for x in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path)).collect()
        assert got and list(got[0].asDict()) == docs.columns, name
        assert {(x.number, x.row, x["a.b"], x.digest, x.score) for x in got} == {("n", "r", "ab", "d", "s")}
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "").collect()
    assert sorted(map(str, ((x.doc_id, x.text) for x in exact))) == sorted(map(str, [(None, text + " "), (1, other), (2, ""), (3, other + " x")]))
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) >= 2
    nothing = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).collect() == []


# ---- ids and texts at the edges ----


@pytest.mark.parametrize("with_null", [False, True])
def test_smallest_id_is_an_id(spark, with_null):
    least = -(1 << 63)
    text = words(random.Random(61), 40)
    rows = [(least, text), (5, text), ((1 << 63) - 1, text + " x")] + [(None, text)] * with_null
    docs = frame(spark, rows)
    assert sorted((x.doc_id for x in suffix_dedup.suffix_dedup(docs).collect()), key=str) == sorted((x[0] for x in rows), key=str)
    exact = {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_dedup(docs).collect()}
    assert exact[least] == (least, 2 + with_null, True) and exact[5] == (least, 2 + with_null, False) and exact[(1 << 63) - 1][2]
    got = token_bits.token_bits(docs, tokenizer_path()).orderBy("start").collect()
    assert [x.doc_id for x in got] == [None] * with_null + [least, 5, (1 << 63) - 1]


def test_language_counts_do_not_depend_on_where_a_text_is_cut(monkeypatch):
    text = "ΑΣ bΣ İx, the ΟΔΟΣ " * 40
    whole = langid.log_odds([text, "ab"], np.arange(2 * 65, dtype=float).reshape(2, 65))
    for piece in (7, 40, len(text.lower()), len(text.lower()) + 1):
        monkeypatch.setattr(langid, "PIECE", piece)
        cut_up = langid.log_odds([text, "ab"], np.arange(2 * 65, dtype=float).reshape(2, 65))
        assert np.allclose(cut_up[0], whole[0]) and (cut_up[1] == whole[1]).all()


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 1000)
    chunks = toxicity.Chunks(len)
    for k in range(30):
        chunks.numbers(f"{k}" + "x" * 400 + " some words here")
    assert sum(map(len, chunks)) < 2000
    coder = token_bits.Encoder(token_bits._contents(tokenizer_path()))
    long = "ab" * 5000
    assert coder.ids(long + " " + long).tolist()[:-1] == coder.tokenizer.encode(long + " " + long, add_special_tokens=False).ids
    assert max(map(len, [*coder.young, *coder.words]), default=0) <= token_bits.SHORT


def test_fixity_of_null_long_and_missing_records_beside_other_columns(spark):
    schema = "page_id long, r string, digest string, node long, n_bytes long"
    rows = [(1, "a"), (2, None), (None, "n"), (3, "c"), (3, "d"), (4, "x" * 3_000_000), (5, "")]
    make = lambda own: fixity.leaves(spark.createDataFrame([(*x, "d", 9, 9) for x in own], schema), "page_id", F.col("r"))
    assert fixity.audit(make(rows), make(rows)).collect() == []
    assert fixity.audit(make(rows), make([])).count() == 6 and fixity.audit(make([]), make([])).count() == 0
    other = [(k, (t or "") + "y" if k in (4, 2) else t) for k, t in rows]
    assert [x.status for x in fixity.audit(make(rows), make(other)).collect()] == ["altered", "altered"]
    assert fixity.audit(make(rows), make([(k, t or "") for k, t in rows])).count() == 0
