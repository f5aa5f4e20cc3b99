"""Operators 11 to 13 against brute force on small tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.llm import embedding_dedup, hard_negatives, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, n long, ends string"
VECTORS = "vec_id long, embedding array<float>, label int, score string, node long"
NAN, INF = float("nan"), float("inf")


# ---- 11 ----


def turn_table(seed=5):
    """Conversations that share openings, copies of one, a long one twice with another end, nulls, ties, negative ids."""
    r = random.Random(seed)
    rows = []
    for c in range(-6, 60):
        shared = r.choice([0, 1, 3])
        for k in range(r.randint(1, 7)):
            text = f"hello {k}" if k < shared else r.choice(["é", "", None, f"own {c % 9} {k}"])
            rows.append((c, k, r.choice(["user", "user", None]) if k >= shared else "user", text))
    for c in range(100, 140):
        rows += [(c, k, "user", f"copy {k}") for k in range(12)]
    for c in (200, 205, 213):
        rows += [(c, k, "user", f"long {k}") for k in range(60)] + [(c, 60, "user", f"end {c % 2}")]
    rows += [(300, None, "a", "first"), (300, 1, "a", "x"), (300, 1, "a", "x"), (300, 1, None, "b"), (None, 1, "a", "nobody's"), (301, 0, "t", "w" * 100_000)]
    r.shuffle(rows)
    return rows


def brute_trie(rows):
    own = {}
    for c, k, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((k is not None, k or 0), digest, len(text.encode())))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:]
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    below, out = {}, {}
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        kids = below.get(node, [])
        saved = (len(members[node]) - 1) * (node[-1][1] if node else 0) + sum(out[k][6] for k in kids)
        leaves = sum(out[k][5] for k in kids) or 1
        ends = ",".join(str(c) for c in sorted(members[node]) if len(full[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[node] = (min(members[node]), len(node), parent, len(members[node]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def trie(spark, rows, limit, stretch=4):
    frame = spark.createDataFrame([(*x, 1, "e") for x in rows], TURNS).repartition(3)
    found = prefix_trie.sequences(prefix_trie.turns(frame), stretch)
    return sorted((tuple(x) for x in prefix_trie.prefix_trie(prefix_trie.rebuilt(found), limit).collect()), key=str)


@pytest.mark.parametrize("limit", [2, 150, 1 << 14])
def test_trie_equals_brute_force_however_often_groups_are_dealt_out(spark, limit):
    rows = turn_table()
    if limit == 2:  # a round for each shared turn
        rows = [x for x in rows if x[0] is None or x[0] < 200 or x[0] >= 300]
    assert trie(spark, rows, limit) == brute_trie(rows)


def test_trie_of_one_long_conversation_needs_no_rounds(spark):
    rows = [(7, k, "user", f"t{k}") for k in range(900)] + [(c, k, "user", f"u{k}") for c in (1000, 1001) for k in range(300)]
    assert trie(spark, rows, 100, stretch=16) == brute_trie(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    assert trie(spark, [], 10) == []
    assert trie(spark, [(None, 1, "a", "b")], 10) == []
    rows = [(1, 0, "a", "b"), (3, 0, "a", "c")]  # no donor 0: what is left depends on the crc alone
    assert trie(spark, rows, 10) == brute_trie(rows)


def test_stretches_go_on_over_tasks(spark):
    frame = spark.createDataFrame([(c, k, "u", f"{c} {k}") for c in (1, 2) for k in range(500)], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.sequences(prefix_trie.turns(frame), 64).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for c in (1, 2):
        own = sorted((x["at"], len(x["sizes"])) for x in got if x["conv_id"] == c)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) == 500


# ---- 12 ----


def vector_table(seed=9, n=420, width=6):
    """Vectors with ties, repeats, shorter ones, nulls and odd components."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = [r.uniform(-1, 1) for _ in range(width)]
        if i % 11 == 3:
            v = rows[r.randrange(len(rows))][1] or v
        rows.append((i, v, i % 3))
    rows += [(500, None, 1), (501, [0.1, None], 1), (502, [NAN, 1.0], 1), (503, [INF, 1.0], 0), (504, [1.0], None), (600, [0.0] * width, 1)]
    rows += [(None, [1.0] * width, 1), (700, [0.5, 0.5], 2), (5, [0.9] * width, 0), (800, [1.0], 77), (900, [], 2)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]


def vectors(spark, rows):
    return spark.createDataFrame([(*x, "s", 1) for x in rows], VECTORS).repartition(4)


def brute_negatives(rows):
    q = [
        (i, [math.floor(256 * x) for x in v], k)
        for i, v, k in rows
        if i is not None and v is not None and k is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, av, ak in q:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v, strict=False)), i, k) for i, v, k in q)
        positives = [(-s, i) for s, i, k in scored if k == ak and i != a][:5]
        for ps, p in positives:
            fit = [(-s, i) for s, i, k in scored if k != ak and 30 * ps <= -100 * s <= 90 * ps][:10]
            out += [(a, p, rank, i, ps, s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("wave", [1, 1 << 22])
def test_hard_negatives_equal_brute_force(spark, wave):
    rows = vector_table()
    got = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0, wave=wave)
    assert sorted(tuple(x) for x in got.collect()) == brute_negatives(rows)


def test_hard_negatives_of_nothing_and_of_large_components(spark):
    none = vectors(spark, []).where("vec_id is null")
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).collect() == []
    big = [(0, [2.0**19, 1.0], 0), (1, [2.0**19, 3.0], 0), (2, [2.0**18, 1.0], 1)]
    got = hard_negatives.hard_negatives(vectors(spark, big), F.col("vec_id") == 0).collect()
    assert [tuple(x) for x in got] == brute_negatives(big) and got
    with pytest.raises(ValueError, match="scale the vectors down"):
        hard_negatives.exact_scores(np.array([[2.0**40]]), np.array([[2.0**40]]))


# ---- 13 ----


def brute_links(rows, threshold=0.9):
    width = max(len(v) for _, v, _ in rows if v is not None)
    own = [
        (n, np.pad(np.array(v, float), (0, width - len(v))))
        for n, (i, v, _) in enumerate(rows)
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    links = {n: set() for n in range(len(rows))}
    for a, x in own:
        for b, y in own:
            if a != b and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
    root = list(range(len(rows)))
    label = {n: rows[n][0] for n in root}
    changed = True
    while changed:
        changed = False
        for a, found in links.items():
            for b in found:
                if label[b] < label[a]:
                    label[a], changed = label[b], True
    return sorted(((rows[n][0], len(links[n]), label[n], rows[n][0] is None or rows[n][0] == label[n]) for n in root), key=str)


def clouds(seed=3, n=900, width=16):
    """Random vectors, copies, near copies at many distances and a large group of them."""
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.standard_normal(width)
    for i in range(n):
        v = rng.standard_normal(width)
        if i % 3 == 1:
            v = centre + rng.standard_normal(width) * rng.uniform(0, 0.35)
        elif i % 7 == 2:
            v = np.array(rows[rng.integers(len(rows))][1]) * 2 + rng.standard_normal(width) * rng.choice([0, 0.1, 0.4])
        rows.append((i * 13 % 997, [float(np.float32(x)) for x in v], 0))
    return rows


def test_near_vectors_equal_brute_force_where_all_meet(spark):
    rows = vector_table()
    got = sorted((tuple(x) for x in embedding_dedup.near_vectors(vectors(spark, rows)).collect()), key=str)
    assert got == brute_links(rows)


def test_near_vectors_find_nine_of_ten_links_in_tables_and_parts(spark):
    rows = clouds()
    want = {x[0]: x for x in brute_links(rows)}
    got = {x.vec_id: x for x in embedding_dedup.near_vectors(vectors(spark, rows), bucket=40, part=50).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].n_links <= want[i][1] for i in got)
    assert sum(x.n_links for x in got.values()) >= 0.9 * sum(x[1] for x in want.values())
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())
    assert sum(got[i].component_id == want[i][2] for i in got) >= 0.9 * len(got)


def test_parts_change_nothing(spark):
    rows = clouds(4, 300)
    one, many = (sorted(tuple(x) for x in embedding_dedup.near_vectors(vectors(spark, rows), bucket=40, part=p).collect()) for p in (8192, 20))
    assert one == many


def test_tables_reach_their_recall_on_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    own = embedding_dedup.unit(rng.standard_normal((3000, 32)))
    coder = embedding_dedup.fit(own[:2000], 200_000)
    assert coder.bits >= 6
    fresh = own[2000:]
    other = embedding_dedup.partners(fresh, 0.9, rng)
    assert np.allclose((fresh * other).sum(1), 0.9)
    a, b = coder.signs(fresh), coder.signs(other)
    met = (coder.keys(a) == coder.keys(b)).any(1) & ((a != b).sum(1) <= coder.radius)
    assert met.mean() >= 0.9
    rotation = coder.rotations[0]
    assert np.allclose(rotation @ rotation.T, np.eye(len(rotation)))
    assert 0.3 < a.mean() < 0.7


def test_near_vectors_of_nothing(spark):
    assert embedding_dedup.near_vectors(vectors(spark, []).where("vec_id is null")).collect() == []
