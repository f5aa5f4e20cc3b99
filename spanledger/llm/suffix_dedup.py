"""Operator 4: removal of repeated byte strings by anchors and hashes of windows, in place of distributed prefix doubling.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier in the corpus. To
know this, every position must be ranked by the LENGTH bytes from it. Doubling ranks all
positions by short strings first, sorts the pairs of ranks at growing offsets and ranks
anew, until a position is unique or the pairs reach LENGTH. Here no ranks are doubled by Spark:

1. Of every LENGTH-byte window the anchor is the BASE-byte string in it with the smallest
   hash; equal windows have equal anchors at equal places. Spark sorts the anchors by rank
   (the hash of the BASE bytes), then by the rank of their context, all windows of the anchor,
   then by position. An anchor with a unique rank is done, and so are all its windows. A
   context that was seen earlier has seen windows only.
2. A first context stays only with the windows whose half reaches a rank at the doubled
   offset that another first context of the anchor shares: the bytes right of the anchor for
   windows that begin near it, those left of it for the others.
3. What is left is taken window by window, sorted by the rank at LENGTH and by position;
   every window but the first of its rank was seen earlier.

Ranks are hashes of 64 bits that are compared in pairs, and sorting is by range partitions,
so that a rank shared by a third of all positions is spread over many tasks. A group that
reaches over the edge of a partition keeps its windows for step 3, and there the edges are
settled from each partition's first and last rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir

LENGTH, BASE = 100, 24
#: Reach of the doubled rank right of an anchor's start; the rest of LENGTH lies left of it.
REACH = 62
#: Bytes worked on at once, and first contexts of an anchor that are compared in memory.
PIECE, HELD = 1 << 18, 100_000
#: Bytes of texts whose rows give the edges of range partitions, and rows of them for each partition.
SAMPLE, EDGE_ROWS = 1 << 25, 200
NO_ID = -(1 << 63)
# Any odd multipliers do.
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]


def doubled(data: np.ndarray) -> list[np.ndarray]:
    """Hashes of the strings of 1, 2, 4 ... 64 bytes from each position, each from two of the one before."""
    out = [(data.astype(np.uint64) + np.uint64(1)) * np.uint64(ODD[0])]
    for k in range(6):
        half = 1 << k
        low, high = out[-1][: len(out[-1]) - half], out[-1][half:]
        value = low * np.uint64(ODD[k + 1]) + (high ^ (high >> np.uint64(29)))
        out.append(value ^ (value >> np.uint64(32)))
    return out


def ranks(powers: list[np.ndarray], length: int) -> np.ndarray:
    """Hashes of the strings of ``length`` bytes from each position."""
    out, at = None, 0
    for k in range(6, -1, -1):
        if length >> k & 1:
            if out is None:
                out = powers[k]
            else:
                n = max(0, min(len(out), len(powers[k]) - at))
                out = out[:n] * np.uint64(0xD6E8FEB86659FD93) + powers[k][at : at + n]
            at += 1 << k
    return out ^ (out >> np.uint64(31))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` neighbours, the first of equal ones."""
    value, index, step = values, np.arange(len(values)), 1
    while step < width:
        move = min(step, width - step)
        low, high = value[: len(value) - move], value[move:]
        later = high < low
        index = np.where(later, index[move:], index[: len(index) - move])
        value = np.where(later, high, low)
        step += move
    return index


def pieces(doc_ids: list[int], texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, documents' numbers, offsets): texts laid end to end; long ones cut with LENGTH - 1 bytes twice."""
    held, numbers, offsets, size = [], [], [], 0

    def flush():
        starts = np.cumsum([0, *map(len, held)])
        return np.frombuffer(b"".join(held), np.uint8), starts, np.array(numbers), np.array(offsets)

    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if held and size + len(part) > PIECE:
                yield flush()
                held, numbers, offsets, size = [], [], [], 0
            held.append(part)
            numbers.append(number)
            offsets.append(at)
            size += len(part)
    if held:
        yield flush()


def _encoded(texts) -> Iterator[bytes]:
    return ((t or "").encode("utf-8", "surrogatepass") for t in texts)


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each anchor of each document: rank, context, doc, first window, windows, place in the first window, halves' ranks."""
    for batch in batches:
        ids = batch["doc_id"].to_numpy(np.int64)
        for data, starts, numbers, offsets in pieces(ids, _encoded(batch["text"])):
            powers = doubled(data)
            base, whole, right, left = (ranks(powers, n) for n in (BASE, LENGTH, REACH, LENGTH - REACH))
            del powers
            anchor = smallest(base, LENGTH - BASE + 1)
            part = np.repeat(np.arange(len(numbers)), np.diff(starts))[: len(anchor)]
            valid = np.arange(len(anchor)) <= starts[part + 1] - LENGTH
            where = np.flatnonzero(valid)
            anchor, part = anchor[where], part[where]
            change = np.ones(len(where), bool)
            change[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(change)
            last = np.append(first[1:], len(where)) - 1
            a, low, n = anchor[first], where[first], last - first + 1
            place = a - low
            context = whole[low] * np.uint64(ODD[1]) ^ whole[where[last]] * np.uint64(ODD[2])
            context ^= (n.astype(np.uint64) * np.uint64(ODD[3])) ^ (place.astype(np.uint64) * np.uint64(ODD[4]))
            reach = LENGTH - REACH
            to_right = right[np.minimum(a, len(right) - 1)].astype(np.int64)
            to_left = left[np.maximum(a - reach, 0)].astype(np.int64)
            small = 0xFFF
            own = part[first]
            start = low - starts[own] + offsets[own]
            # 31 bits of position, 7 each of windows and place, 9 each of the halves' ranks.
            halves = ((to_right >> 20) & 0x1FF) << 9 | ((to_left >> 20) & 0x1FF)
            yield pd.DataFrame(
                {
                    "rank": base[a].view(np.int64),
                    "context": context.view(np.int64),
                    "doc": ids[numbers[own]],
                    "place": start.astype(np.int64) << 32 | n.astype(np.int64) << 25 | place.astype(np.int64) << 18 | halves,
                }
            )


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, bool, bool]]:
    """Rows in which groups of equal keys are whole, with whether they begin or end the partition.

    A group that outgrows HELD rows is given in several parts, each marked as an edge.
    """
    rest, begun = None, False
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        own = rest[keys].to_numpy()
        change = np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1
        if len(change):
            yield rest.iloc[: change[-1]], not begun, False
            rest, begun = rest.iloc[change[-1] :], True
        elif len(rest) > HELD:
            yield rest, True, True
            rest, begun = None, False
    if rest is not None and len(rest):
        yield rest, not begun, True


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Steps 1 and 2 over sorted anchors: seen contexts, and windows of first contexts to compare one by one."""
    for rows, begins, ends in _groups(batches, ["rank"]):
        rank, context = rows["rank"].to_numpy(np.int64), rows["context"].to_numpy(np.int64)
        doc, place = rows["doc"].to_numpy(np.int64), rows["place"].to_numpy(np.int64)
        n, at, start = (place >> 25) & 0x7F, (place >> 18) & 0x7F, place >> 32
        new_rank = np.ones(len(rows), bool)
        new_rank[1:] = rank[1:] != rank[:-1]
        new = new_rank.copy()
        new[1:] |= context[1:] != context[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        same_place = (doc == doc[first]) & (start == start[first])
        seen = ~new & ~same_place
        yield pd.DataFrame({"doc": doc[seen], "start": start[seen], "n": n[seen].astype(np.int32), "rank": 0, "seen": True})
        # First contexts whose rank has another context, or that stand at an edge.
        group = np.cumsum(new_rank) - 1
        contexts = np.bincount(group[new], minlength=group[-1] + 1)
        edge = np.zeros(group[-1] + 1, bool)
        edge[0] |= begins
        edge[-1] |= ends
        pick = new & ((contexts > 1) | edge)[group]
        group, rank, doc, start, n, at, half = (x[pick] for x in (group, rank, doc, start, n, at, place & 0x3FFFF))
        anyway = edge[group]
        # A window of place p (its anchor's) holds REACH bytes from the anchor if p <= reach, else reach bytes before it.
        reach = LENGTH - REACH
        low_place = at - (n - 1)
        for half_rank, low, high in ((half >> 9, low_place, np.minimum(at, reach)), (half & 0x1FF, np.maximum(low_place, reach + 1), at)):
            key = group << 9 | half_rank
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            take = (high >= low) & (anyway | (count[back] > 1))
            yield pd.DataFrame(
                {
                    "doc": doc[take],
                    "start": (start + at - high)[take],
                    "n": (high - low + 1)[take].astype(np.int32),
                    "rank": rank[take],
                    "seen": False,
                }
            )


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of each document's runs: rank, the whole window's rank, doc and position.

    Runs that lie close share their bytes; the stretches of many documents are hashed end to end.
    """
    held: list[bytes] = []
    rows: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pd.DataFrame:
        whole = ranks(doubled(np.frombuffer(b"".join(held), np.uint8)), LENGTH)
        at, rank, doc, start = (np.concatenate(x) for x in zip(*rows, strict=True))
        return pd.DataFrame({"rank": rank, "whole": whole[at].view(np.int64), "doc": doc, "start": start})

    for batch in batches:
        for doc, text, start, n, rank in zip(batch["doc_id"], _encoded(batch["text"]), batch["starts"], batch["counts"], batch["ranks"], strict=True):
            order = np.argsort(start, kind="stable")
            start, n, rank = np.asarray(start, np.int64)[order], np.asarray(n, np.int64)[order], np.asarray(rank, np.int64)[order]
            reach = np.maximum.accumulate(start + n) + LENGTH - 1
            fresh = np.ones(len(start), bool)
            fresh[1:] = (start[1:] >= reach[:-1]) | (start[1:] // PIECE != start[:-1] // PIECE)
            first = np.flatnonzero(fresh)
            low, high = start[first], np.maximum.reduceat(start + n, first) + LENGTH - 1
            base = size + np.cumsum(high - low) - (high - low)
            held.extend(text[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True))
            size = int(base[-1] + high[-1] - low[-1])
            shift = (base - low)[np.cumsum(fresh) - 1]
            own = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows.append((own + np.repeat(shift, n), np.repeat(rank, n), np.full(len(own), doc), own))
            if size > PIECE:
                yield flush()
                held, rows, size = [], [], 0
    if rows:
        yield flush()


def _later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 3 over sorted windows: those that are not the first of their rank, and the partition's edges.

    kind 0: seen earlier. Of each partition one row of kind 1 and one of kind 2, its first and
    its last window.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    before = None
    last = None
    for rows in batches:
        if not len(rows):
            continue
        own = rows[["rank", "whole", "doc", "start"]].to_numpy(np.int64)
        if before is None:
            yield pd.DataFrame([[1, part, *own[0]]], columns=["kind", "part", "rank", "whole", "doc", "start"])
            before = own[0]
        full = np.vstack([before, own])
        new = np.ones(len(full), bool)
        new[1:] = (full[1:, :2] != full[:-1, :2]).any(1)
        first = np.maximum.accumulate(np.where(new, np.arange(len(full)), 0))
        seen = (full[:, :2] == full[first][:, :2]).all(1) & (full[:, 2:] != full[first][:, 2:]).any(1)
        rows_ = full[1:][seen[1:]]
        yield pd.DataFrame({"kind": 0, "part": part, "rank": 0, "whole": 0, "doc": rows_[:, 2], "start": rows_[:, 3]})
        before = full[first[-1]]
        last = own[-1]
    if last is not None:
        yield pd.DataFrame([[2, part, *last]], columns=["kind", "part", "rank", "whole", "doc", "start"])


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc, text, runs in zip(batch["doc_id"], _encoded(batch["text"]), batch["runs"], strict=True):
            spans = merged(np.array(runs, np.int64)) if runs is not None and len(runs) else []
            kept, at = hashlib.sha256(), 0
            for low, high in spans:
                kept.update(text[at:low])
                at = high
            kept.update(text[at:])
            out.append((doc, len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged(runs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal byte spans covered by runs of windows, each start << 32 | number of windows."""
    runs = np.sort(runs)
    low = runs >> 32
    high = np.maximum.accumulate(low + (runs & 0xFFFFFFFF) + LENGTH - 1)
    apart = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    return list(zip(low[apart].tolist(), high[np.append(apart[1:], len(runs)) - 1].tolist(), strict=True))


def below(edges: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many of the sorted edges are at or below each row; rows and edges are compared column by column."""
    low, high = (np.searchsorted(edges[:, 0], rows[:, 0], side) for side in ("left", "right"))
    for k in range(1, edges.shape[1]):
        tied = np.flatnonzero(low != high)  # alike with an edge so far
        begin = low[tied]
        for at in np.unique(begin).tolist():
            own = tied[begin == at]
            own_edges = edges[at : high[own[0]], k]
            low[own], high[own] = (at + np.searchsorted(own_edges, rows[own, k], side) for side in ("left", "right"))
    return high


def ranged(rows: DataFrame, texts: int, mapper: Callable, schema: str, order: list[str], parts: int) -> DataFrame:
    """The rows that mapper makes of rows with a doc_id and a text, sorted within range partitions by ``order``.

    ``repartitionByRange`` would run the mapper twice, first for a sample of its rows. Here
    the edges come from the rows of about SAMPLE of the ``texts`` bytes, taken by a hash of
    the id; they decide how even the partitions are and nothing else. Where they are too few
    (all texts are long), the first column, a hash, is cut evenly.
    """
    share = min(1.0, SAMPLE / max(texts, 1))
    every = max(1, int(min(texts, SAMPLE) / 20 / (EDGE_ROWS * parts)))
    place = F.pmod(F.xxhash64("doc_id", F.lit("edges")), F.lit(1 << 20))
    few = rows.where((place < F.lit(int(share * (1 << 20)))) & (F.octet_length("text") <= PIECE)).mapInPandas(mapper, schema)
    few = few.select(*order).where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).collect()
    if len(few) >= parts:
        few = sorted(tuple(r) for r in few)
        edges = np.array([few[len(few) * k // parts] for k in range(1, parts)], np.int64).reshape(-1, len(order))
    else:
        edges = np.zeros((parts - 1, len(order)), np.int64)
        edges[:, 0] = [-(1 << 63) + (k << 64) // parts for k in range(1, parts)]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in mapper(batches):
            out["part"] = below(edges, out[order].to_numpy(np.int64)).astype(np.int32)
            yield out

    found = rows.mapInPandas(placed, f"{schema}, part int")
    return found.repartitionById(parts, "part").drop("part").sortWithinPartitions(*order)


def removed_runs(docs: DataFrame) -> DataFrame:
    """(doc, start, n): windows that were seen earlier, as runs; docs has unique doc_id and text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = fresh_dir(spark, "suffix")
    texts = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = "rank long, context long, doc long, place long"
    ranked = ranged(docs.select("doc_id", "text"), texts, _anchors, schema, ["rank", "context", "doc", "place"], parts)
    ranked.mapInPandas(_kept, "doc long, start long, n int, rank long, seen boolean").write.parquet(f"{folder}/anchors")
    ranked = spark.read.parquet(f"{folder}/anchors")
    open_ = ranked.where("not seen").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "n", "rank")).alias("runs"))
    open_ = open_.select("doc_id", F.col("runs.start").alias("starts"), F.col("runs.n").alias("counts"), F.col("runs.rank").alias("ranks"))
    windows = docs.join(open_, "doc_id").select("doc_id", "text", "starts", "counts", "ranks")
    later = ranged(windows, texts, _windows, "rank long, whole long, doc long, start long", ["rank", "whole", "doc", "start"], parts)
    later.mapInPandas(_later, "kind int, part int, rank long, whole long, doc long, start long").write.parquet(f"{folder}/windows")
    later = spark.read.parquet(f"{folder}/windows")
    # Two rows of each partition: a first window is seen if the partition before ends with its rank.
    edges = sorted((r["part"], r["kind"], r["rank"], r["whole"], r["doc"], r["start"]) for r in later.where("kind > 0").collect())
    seen = [(e[4], e[5], 1) for before, e in zip(edges, edges[1:], strict=False) if e[1] == 1 and before[2:4] == e[2:4]]
    single = later.where("kind = 0").select("doc", "start", F.lit(1).alias("n"))
    seen_rows = spark.createDataFrame(seen, "doc long, start long, n int")
    return ranked.where("seen").select("doc", "start", "n").unionByName(single).unionByName(seen_rows)


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each distinct (doc_id, text) once as (doc_id, text), under a number in the order of ids and text hashes; and (doc_id, id, times) of the numbers.

    Both are written, so that the numbers stay. Rows without an id come first.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = fresh_dir(spark, "suffix-rows")
    own = ["known", "id", "digest"]
    text = F.coalesce("text", F.lit(""))
    rows = rows.select(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    rows.groupBy(*own).agg(F.first("text").alias("text"), F.count("*").alias("times")).write.parquet(f"{folder}/texts")
    once = spark.read.parquet(f"{folder}/texts")
    sorted_ = once.select(*own, "times").repartitionByRange(parts, *own).sortWithinPartitions(*own)
    sorted_.withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(f"{folder}/numbers")
    numbers = spark.read.parquet(f"{folder}/numbers")
    once.select(*own, "text").join(numbers.select(*own, "doc_id"), own).select("doc_id", "text").write.parquet(f"{folder}/numbered")
    return spark.read.parquet(f"{folder}/numbered"), numbers.select("doc_id", F.when(F.col("known"), F.col("id")).alias("id"), "times")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, judged on the whole input.

    Texts are taken as UTF-8, null as empty. Earlier means a smaller doc_id, or an earlier
    start in the same document; rows without an id come first, and rows that repeat an id
    (or have none) follow each other by the SHA-256 of their texts. Only rows alike in id and
    text are one document, and each carries its answer. Documents shorter than 100 bytes lose
    nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    key = F.coalesce("id", F.lit(NO_ID))
    repeated = not rows.groupBy(key).agg(F.count("*").alias("times")).where("times > 1").isEmpty()
    if repeated:
        rows, numbers = _numbered(rows)
    else:
        rows = rows.select(key.alias("doc_id"), "text")
    runs = removed_runs(rows).groupBy(F.col("doc").alias("doc_id"))
    runs = runs.agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("n").cast("long"))).alias("runs"))
    out = rows.join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInPandas(
        _cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    if repeated:
        again = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
        out = out.join(numbers, "doc_id").withColumn("_again", again).withColumn("doc_id", F.col("id"))
        return out.drop("id", "times", "_again")
    if rows.where(F.col("doc_id") == NO_ID).isEmpty() or docs.where(F.col("doc_id").isNull()).isEmpty():
        return out
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
