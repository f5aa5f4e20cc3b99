"""Operator 7: SimHash near-deduplication by a binary-trie self-join.

Fingerprints are made document by document; equal ones become one. The distinct ones are
joined with themselves by walking a binary trie with pairs of nodes: a pair's children are
taken together, differing bits add up, and a pair whose bits differ more often than the
budget allows is dropped with all below it.

To spread one trie over many tasks the bits are cut into b blocks. Two fingerprints that
differ in at most 4 bits agree in at least b - 4 whole blocks; so for each choice of b - 4
blocks the trie is laid out with those bits first and each of its subtrees below them is
joined with itself on its own, already at distance 0. All choices together miss no link. b
grows with the number of fingerprints, so that subtrees stay small. A subtree too large for a
task is dealt into parts and each pair of parts is walked by a task of its own.

A task reports links as edges of a spanning forest of what it found, so a large group of near
copies never turns into all its pairs; node pairs whose fingerprints are connected already
are dropped as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts
from .components import components

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a subtree, about, for which the number of blocks is chosen, and most of one part.
SUBTREE, PART = 512, 4096
#: Pairs of nodes walked at once, which bounds a task's memory.
WALK = 1 << 20
#: Bytes from which a text is taken in parts.
LONG = 1 << 20


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash over XXH64 of word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    raw = (text or "").encode("utf-8", "surrogatepass")
    total, n, carried = np.zeros(64, np.int64), 0, []
    for part in parts(raw, LONG):
        words = carried + part.lower().split()  # bytes: A-Z and ASCII white space only
        hashes = _hashes(words, size, seed) if len(words) >= size else []
        n += len(hashes)
        _add(total, hashes)
        carried = words[max(len(words) - size + 1, 0) :]
    if not n and carried:  # fewer words than a shingle has
        _add(total, [xxh64_intdigest(b" ".join(carried), seed)])
        n = 1
    return sum(1 << k for k in np.flatnonzero(total * 2 > n).tolist())


def _hashes(words: list[bytes], size: int, seed: int) -> list[int]:
    """XXH64 of every run of ``size`` words, joined by spaces."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=False)]


def _add(total: np.ndarray, hashes: list[int]) -> None:
    """Adds how many of the hashes have each bit."""
    for at in range(0, len(hashes), 1 << 16):
        own = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        np.add(total, np.unpackbits(own, axis=1, bitorder="little").sum(0, dtype=np.int64), out=total)


def forest(n: int, labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the labels (smallest member of each set) of all pairs a, b in place."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            deeper = labels[labels]
            if (deeper == labels).all():
                break
            labels[:] = deeper


def walk(values: np.ndarray, pairs: np.ndarray, budget: int = DISTANCE) -> np.ndarray:
    """Labels that connect all values at ``budget`` or fewer differing bits under the given node pairs.

    values: uint64, ascending within each node. pairs: rows (a_low, a_high, b_low, b_high) of
    index ranges; a node paired with itself has its range twice. Nothing is connected across
    pairs that are not given.
    """
    labels = np.arange(len(values))
    stack = [(0, pairs.astype(np.int64), np.zeros(len(pairs), np.int64))]
    ones: dict[int, np.ndarray] = {}

    def split(depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)])
        return high - (ones[depth][high] - ones[depth][low])

    while stack:
        depth, at, errors = stack.pop()
        if len(at) > WALK:
            half = len(at) // 2
            stack += [(depth, at[half:], errors[half:]), (depth, at[:half], errors[:half])]
            continue
        # Two leaves: compare the values outright.
        leaf = (at[:, 1] - at[:, 0] == 1) & (at[:, 3] - at[:, 2] == 1)
        a, b = at[leaf, 0], at[leaf, 2]
        differ = np.bitwise_count(values[a] ^ values[b]) <= budget
        forest(len(values), labels, a[differ], b[differ])
        at, errors = at[~leaf], errors[~leaf]
        if not len(at):
            continue
        if depth == 64:  # equal values below one node
            for a0, a1, b0, b1 in at:
                forest(len(values), labels, np.arange(a0, a1), np.full(a1 - a0, b0))
                forest(len(values), labels, np.arange(b0, b1), np.full(b1 - b0, a0))
            continue
        a_mid, b_mid = split(depth, at[:, 0], at[:, 1]), split(depth, at[:, 2], at[:, 3])
        same = (at[:, 0] == at[:, 2]) & (at[:, 1] == at[:, 3])
        zero_a, one_a = (at[:, 0], a_mid), (a_mid, at[:, 1])
        zero_b, one_b = (at[:, 2], b_mid), (b_mid, at[:, 3])
        more, cost = [], []
        for left, right, step, use in ((zero_a, zero_b, 0, None), (one_a, one_b, 0, None), (zero_a, one_b, 1, None), (one_a, zero_b, 1, ~same)):
            ok = (left[1] > left[0]) & (right[1] > right[0]) & (errors + step <= budget)
            if use is not None:  # a node with itself: its halves meet once
                ok &= use
            rows = np.stack([left[0], left[1], right[0], right[1]], 1)[ok]
            alone = (rows[:, 0] == rows[:, 2]) & (rows[:, 1] - rows[:, 0] == 1) & (rows[:, 3] - rows[:, 2] == 1)
            more.append(rows[~alone])
            cost.append((errors[ok] + step)[~alone])
        rows, cost_ = np.concatenate(more), np.concatenate(cost)
        if len(rows):
            stack.append((depth + 1, rows, cost_))
    return labels


def rotate(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The bits of each value in the given order, most significant first."""
    out = np.zeros(len(values), np.uint64)
    for k, bit in enumerate(order):
        out |= ((values >> np.uint64(63 - int(bit))) & np.uint64(1)) << np.uint64(63 - k)
    return out


def layouts(count: int) -> list[tuple[int, np.ndarray]]:
    """(leading bits that must agree, order of all bits) for each choice of blocks, for so many fingerprints."""
    for blocks in range(DISTANCE + 1, 2 * DISTANCE + 1):
        edges = [64 * k // blocks for k in range(blocks + 1)]
        lead = min(sum(sorted(edges[i + 1] - edges[i] for i in range(blocks))[: blocks - DISTANCE]), 32)
        if count >> lead <= SUBTREE:
            break
    out = []
    for chosen in combinations(range(blocks), blocks - DISTANCE):
        front = [b for i in chosen for b in range(edges[i], edges[i + 1])]
        out.append((len(front), np.array([*front, *[b for b in range(64) if b not in set(front)]])))
    return out


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly what links of distinct fingerprints (column fp, long) connect."""
    plans = layouts(prints.count())

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            for k, (lead, order) in enumerate(plans):
                turned = rotate(fp.view(np.uint64), order)
                yield pd.DataFrame({"plan": np.int32(k), "head": (turned >> np.uint64(64 - lead)).astype(np.int64), "turned": turned.view(np.int64), "fp": fp})

    rows = cut(prints.select("fp").mapInPandas(dealt, "plan int, head long, turned long, fp long"))
    heads = rows.groupBy("plan", "head").agg(F.count("*").alias("n")).where("n > 1")
    heads = cut(heads.select("plan", "head", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    rows = rows.join(heads, ["plan", "head"])
    # A row of part p meets each part q in the task (smaller, larger).
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tasks = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = tasks.select(
        "plan", "head", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "turned", "fp"
    )

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = batch[["plan", "head", "i", "j"]].to_numpy()
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if not len(change):
                rest = batch
                continue
            yield tried(batch.iloc[: change[-1]])
            rest = batch.iloc[change[-1] :]
        if rest is not None and len(rest):
            yield tried(rest)

    def tried(batch: pd.DataFrame) -> pd.DataFrame:
        """All tasks of the batch walked together; rows come sorted by task, part and turned bits."""
        keys = batch[["plan", "head", "i", "j"]].to_numpy()
        values = batch["turned"].to_numpy(np.int64).view(np.uint64)
        own = batch["own"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        ends = np.append(starts[1:], len(keys))
        cross = keys[starts, 2] != keys[starts, 3]
        inner = np.append(0, np.cumsum(own[1:] != own[:-1]))
        pairs = [np.stack([starts, ends, starts, ends], 1)[~cross]]
        if cross.any():
            middle = [s + int(np.searchsorted(inner[s:e] - inner[s], 1)) for s, e in zip(starts[cross], ends[cross], strict=True)]
            pairs.append(np.stack([starts[cross], middle, middle, ends[cross]], 1))
        pairs = np.concatenate(pairs)
        pairs = pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & ((pairs[:, 1] - pairs[:, 0] > 1) | (pairs[:, 0] != pairs[:, 2]))]
        labels = walk(values, pairs)
        child = np.flatnonzero(labels != np.arange(len(labels)))
        fp = batch["fp"].to_numpy(np.int64)
        return pd.DataFrame({"a": fp[child], "b": fp[labels[child]]})

    order = ["plan", "head", "i", "j", "own"]
    sorted_ = tasks.repartition("plan", "head", "i", "j").sortWithinPartitions(*order, F.col("turned") < 0, "turned")
    return sorted_.mapInPandas(joined, "a long, b long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id reachable) of every document.

    docs needs doc_id (integer) and text. A null or empty text has fingerprint 0 and is linked
    like any other. Repeated rows stay; a row without an id has the smallest id of its group,
    or null where the whole group has none.
    """

    @F.pandas_udf("long")
    def marked(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), marked("text").alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(prints))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = cut(placed)
    named = cut(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut(placed.join(named, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
