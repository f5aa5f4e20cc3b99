"""Operator 11: the prefix trie of conversations.

Turns become digests and byte counts; texts are not shuffled. Conversations are put in order
by a range sort and travel in stretches of at most ``STRETCH`` turns, so one of any length is
many rows over many tasks. Equal conversations become one with a weight; their ids are hashed
as a stream, in order, piece by piece.

The subtrie below a first turn belongs to one task: groups are hash-partitioned by the digest
of their turns so far, and a task builds each as dictionaries of child pointers and sums it in
an iterative postorder. A group of more than ``LIMIT`` turns is not built: its top node is
aggregated, its conversations are dealt out again by their next turn, and so on for those
groups that are still too large. When all are built, the tops' sums go back up. A conversation
that is alone in its group needs no trie, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, field, small

#: Turns of a group that one task builds, and of a row.
LIMIT, STRETCH = 1 << 14, 1 << 10
WIDE = 32  # bytes of a digest
NOBODY = hashlib.sha256(b"").hexdigest()
SEQUENCE = "conv_id long, at long, digests binary, sizes array<long>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, bytes of the text; rows without conv_id belong to none."""
    role, text = (F.coalesce(field(c).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(field("conv_id").isNotNull()).select(
        field("conv_id").cast("long").alias("conv_id"),
        field("turn").alias("turn"),
        F.unhex(F.sha2(framed, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def sequences(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Turns in order (null first, equal ones by digest) as stretches: conv_id, at (turns before it), digests end to end, sizes.

    A conversation that reaches over several tasks goes on counting where the task before ended;
    for that, each task's first and last conversation is told to the driver, a row a task.
    """
    order = ["conv_id", "turn", "digest"]
    ordered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id()).drop("turn"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = task = None
        n = 0  # rows of the last conversation
        for batch in batches:
            ids = np.asarray(batch.column("conv_id"))
            if not len(ids):
                continue
            if first is None:
                first, task = int(ids[0]), batch.column("task")[0].as_py()
            own = int((ids == ids[-1]).sum())
            n = n + own if last == ids[-1] else own
            last = int(ids[-1])
        if first is not None:
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "first": [first], "last": [last], "n": [n]})

    told = sorted(tuple(r) for r in ordered.select("conv_id", "task").mapInArrow(edges, "task int, first long, last long, n long").collect())
    before, last, carried = {}, None, 0
    for task, first, end, n in told:
        before[task] = carried if first == last else 0
        carried = before[task] + n if first == end else n
        last = end

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at = None, 0
        for batch in batches:
            ids = np.asarray(batch.column("conv_id"))
            if not len(ids):
                continue
            if conv is None:
                conv, at = ids[0], before[batch.column("task")[0].as_py()]
            raw, sizes = b"".join(batch.column("digest").to_pylist()), np.asarray(batch.column("n_bytes"))
            out: tuple[list, ...] = ([], [], [], [])
            ends = np.append(np.flatnonzero(np.diff(ids)) + 1, len(ids)).tolist()
            for low, high in zip([0, *ends], ends, strict=False):
                if ids[low] != conv:
                    conv, at = ids[low], 0
                for a in range(low, high, stretch):
                    b = min(a + stretch, high)
                    for into, x in zip(out, (int(conv), at, raw[WIDE * a : WIDE * b], sizes[a:b]), strict=True):
                        into.append(x)
                    at += b - a
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))],
                ["conv_id", "at", "digests", "sizes"],
            )

    return ordered.mapInArrow(gather, SEQUENCE)


def with_heads_of(found: DataFrame, donor: Column, n: Column, most: int) -> DataFrame:
    """The sequences with their first n turns replaced by the first n of another conversation, as far as it has them.

    donor and n (at most ``most``) are columns over conv_id. A conversation left without any
    turn stays as a row without turns.
    """
    opening = found.where(F.col("at") < most).groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "at",
                    F.expr(f"substring(digests, 1, cast({WIDE} * ({most} - at) as int))").alias("digests"),
                    F.expr(f"slice(sizes, 1, cast({most} - at as int))").alias("sizes"),
                )
            )
        ).alias("head")
    )
    opening = opening.select(
        F.col("conv_id").alias("donor"),
        F.expr("aggregate(head, cast('' as binary), (a, x) -> concat(a, x.digests))").alias("head"),
        F.flatten("head.sizes").alias("head_sizes"),
    )
    every = found.groupBy("conv_id").agg(F.max(F.col("at") + F.size("sizes")).alias("n"))
    every = every.withColumn("donor", donor).withColumn("k", n.cast("int")).join(opening, "donor", "left")
    every = every.withColumn("got", F.when(F.col("head_sizes").isNull(), F.lit(0)).otherwise(F.least("k", F.size("head_sizes"))))
    heads = every.where("got > 0 or n <= k").select(
        "conv_id",
        F.lit(0).cast("long").alias("at"),
        F.expr(f"coalesce(substring(head, 1, {WIDE} * got), cast('' as binary))").alias("digests"),
        F.expr("coalesce(slice(head_sizes, 1, got), array())").cast("array<long>").alias("sizes"),
    )
    rest = found.join(every.select("conv_id", "k", "got"), "conv_id").where(F.col("at") + F.size("sizes") > F.col("k"))
    rest = rest.withColumn("skip", F.greatest(F.col("k") - F.col("at"), F.lit(0)).cast("int"))
    rest = rest.select(
        "conv_id",
        (F.greatest(F.col("at"), F.col("k").cast("long")) - F.col("k") + F.col("got")).alias("at"),
        F.expr(f"substring(digests, {WIDE} * skip + 1)").alias("digests"),
        F.expr("slice(sizes, skip + 1, size(sizes))").alias("sizes"),
    )
    return heads.unionByName(rest)


def distinct_sequences(found: DataFrame) -> DataFrame:
    """Equal sequences as one: conv_id (the smallest), n (turns), weight (how many), ends (SHA-256 of their ids)."""

    def lane(salt: int) -> Column:
        one = f"xxhash64({salt}, at + i, substring(digests, {WIDE} * i + 1, {WIDE}))"
        return F.expr(f"if(size(sizes) = 0, 0L, aggregate(sequence(0, size(sizes) - 1), 0L, (a, i) -> a ^ {one}))")

    # 128 bits over all (place, digest) pairs, whatever stretches they came in.
    key = ["x", "y", "n"]
    each = found.select("conv_id", lane(1).alias("x"), lane(2).alias("y"), F.size("sizes").cast("long").alias("n"))
    each = each.groupBy("conv_id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("n").alias("n"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            columns = batch[key].to_numpy()
            ids = batch["conv_id"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1])
            ends = np.append(starts[1:], len(ids))
            out = batch.iloc[starts].reset_index(drop=True)
            out["weight"] = ends - starts
            out["ids"] = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, ends, strict=True)]
            yield out

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, weight, state = None, 0, 0, None
        for batch in batches:
            out = []
            for conv, x, y, n, own, ids in batch.itertuples(index=False):
                if (x, y, n) == last:
                    state.update(b",")
                    weight += own
                else:
                    if last is not None:
                        out.append((held, last[2], weight, state.hexdigest()))
                    last, held, weight, state = (x, y, n), conv, own, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=["conv_id", "n", "weight", "ends"])
        if last is not None:
            yield pd.DataFrame([(held, last[2], weight, state.hexdigest())], columns=["conv_id", "n", "weight", "ends"])

    # Sorted in ranges, so that the ids of one sequence may be in many tasks; the pieces are few.
    ranged = each.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    told = ranged.select("conv_id", *key).mapInPandas(pieces, "conv_id long, x long, y long, n long, weight long, ids string")
    told = told.repartition(*key).sortWithinPartitions(*key, "conv_id")
    return told.mapInPandas(unite, "conv_id long, n long, weight long, ends string")


def _build(depth: int):
    """Tries of whole groups whose top nodes have a depth; rows of the nodes, the tops with the group above them."""

    def build(table: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        children: list[dict[bytes, int]] = []
        nodes: list[list] = []  # conv_id, depth, parent, members, bytes, ends

        def finish(above: bytes, above_conv: int) -> None:
            order, stack = [], [1]
            while stack:  # children stand behind their parents
                v = stack.pop()
                order.append(v)
                stack.extend(children[v].values())
            leaves, saved = [0] * len(nodes), [0] * len(nodes)
            for v in reversed(order):
                conv, level, parent, members, size, ends = nodes[v]
                leaves[v] += not children[v]
                saved[v] += (members - 1) * size
                leaves[parent] += leaves[v]
                saved[parent] += saved[v]
                top = parent == 0
                out.append(
                    (conv, level, above_conv if top else nodes[parent][0], members, len(children[v]), leaves[v], saved[v], ends, above if top else None)
                )

        last, conv, v, above = None, None, 0, (b"", 0)
        columns = ["group", "conv_id", "at", "digests", "sizes", "n", "weight", "ends", "above", "above_conv"]
        for group, own, at, digests, sizes, n, weight, ends, up, up_conv in table.sort_values(columns[:3])[columns].itertuples(index=False):
            if group != last:
                if last is not None:
                    finish(*above)
                children, nodes, last, conv, above = [{}], [[0, depth - 1, 0, 0, 0, NOBODY]], group, None, (up, up_conv)
            if own != conv:  # by rising id, so that the first to come has a node's smallest
                conv, v = own, 0
            for k in range(max(depth - 1 - at, 0), len(sizes)):
                digest = digests[WIDE * k : WIDE * k + WIDE]
                w = children[v].get(digest)
                if w is None:
                    w = children[v][digest] = len(nodes)
                    children.append({})
                    nodes.append([own, at + k + 1, v, 0, int(sizes[k]), NOBODY])
                nodes[w][3] += weight
                v = w
            if at + len(sizes) == n:
                nodes[v][5] = ends
        if last is not None:
            finish(*above)
        return pd.DataFrame(out, columns=[*(f.split()[0] for f in NODE.split(", ")), "above"])

    return build


def _chain(depth: int):
    """Nodes of conversations that are alone in their groups, by stretches; later: bytes behind the stretch."""

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                skip = max(depth - 1 - r.at, 0)
                sizes = np.asarray(r.sizes, np.int64)[skip:]
                if not len(sizes):
                    continue
                levels = np.arange(r.at + skip + 1, r.at + skip + 1 + len(sizes))
                top, end = levels == depth, levels == r.n
                yield pd.DataFrame(
                    {
                        "conv_id": r.conv_id,
                        "depth": levels,
                        "parent_conv_id": np.where(top, r.above_conv, r.conv_id),
                        "n_convs": r.weight,
                        "n_children": (~end).astype(np.int64),
                        "n_leaves": 1,
                        "saved_tokens": (r.weight - 1) * (np.cumsum(sizes[::-1])[::-1] + r.later),
                        "ends_sha256": np.where(end, r.ends, NOBODY),
                        "above": [r.above if t else None for t in top],
                    }
                )

    return chain


def prefix_trie(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of sequences (see ``sequences``), the textless root included, one row each.

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id (root: null); n_convs:
    members; n_children; n_leaves: childless nodes of the subtree, its top included;
    saved_tokens: (n_convs - 1) times the bytes of the last text, summed over the subtree;
    ends_sha256: SHA-256 of the ids of members that end here. Without conversations there is
    no node. Two sequences count as equal when their turns' SHA-256 digests are.
    """
    found = cut(found)
    reps = cut(distinct_sequences(found))
    rows = cut(found.join(reps, "conv_id"))
    nobody = F.lit(NOBODY)
    open_ = reps.select(
        "conv_id", "n", "weight", "ends",
        F.lit(b"").alias("group"), F.lit(0).cast("long").alias("n_bytes"),
        F.lit(None).cast("binary").alias("above"), F.lit(None).cast("long").alias("above_conv"),
    )
    done: list[DataFrame] = []  # the nodes built in each round
    split: list[DataFrame] = []  # the tops of the groups dealt out again in each round
    depth = 0
    while True:
        groups = cut(
            open_.groupBy("group").agg(
                F.first("above").alias("above"),
                F.first("above_conv").alias("above_conv"),
                F.min("conv_id").alias("conv_id"),
                F.sum("weight").alias("n_convs"),
                F.count("*").alias("m"),
                F.sum(F.col("n") - depth + 1).alias("turns"),
                F.max("n_bytes").alias("n_bytes"),
                F.max(F.when(F.col("n") == depth, F.col("ends"))).alias("ends"),
            )
        )
        large = (F.col("turns") > limit) & (F.col("m") > 1) | F.lit(depth == 0)
        alone = (F.col("turns") > limit) & (F.col("m") == 1) & F.lit(depth > 0)
        kind = F.when(large, "large").when(alone, "alone").otherwise("built")
        groups = groups.withColumn("kind", kind)
        totals = {r["kind"]: (r["n"], r["turns"]) for r in groups.groupBy("kind").agg(F.count("*").alias("n"), F.sum("turns").alias("turns")).collect()}
        nodes = []
        with_rows = rows.join(open_.select("conv_id", "group", "above", "above_conv"), "conv_id")
        if "built" in totals:
            # Groups share a call so that one has about as many turns as the largest group may have.
            tasks = max(totals["built"][1] * 2 // limit, 1)
            chosen = with_rows
            if len(totals) > 1:
                chosen = chosen.join(small(groups.where("kind <> 'built'").select("group")), "group", "left_anti")
            chosen = chosen.withColumn("task", F.pmod(F.xxhash64("group"), F.lit(tasks)))
            nodes.append(chosen.groupBy("task").applyInPandas(_build(depth), NODE + ", above binary"))
        if "alone" in totals:
            chosen = with_rows.join(small(groups.where("kind = 'alone'").select("group")), "group")
            behind = Window.partitionBy("conv_id").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
            bytes_ = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
            chosen = chosen.withColumn("later", F.coalesce(F.sum(bytes_).over(behind), F.lit(0)))
            nodes.append(chosen.mapInPandas(_chain(depth), NODE + ", above binary"))
        if nodes:
            done.append(cut(nodes[0] if len(nodes) == 1 else nodes[0].unionByName(nodes[1])))
        else:
            done.append(None)
        if "large" not in totals:
            break
        tops = groups.where("kind = 'large'")
        split.append(tops)
        digest = F.expr(f"substring(digests, cast({WIDE} * ({depth} - at) as int) + 1, {WIDE})")
        here = rows.where((F.col("at") <= depth) & (F.col("at") + F.size("sizes") > depth)).select(
            "conv_id", digest.alias("digest"), F.expr(f"sizes[cast({depth} - at as int)]").alias("n_bytes")
        )
        dealt = open_.drop("n_bytes", "above", "above_conv").join(small(tops.select("group", F.col("conv_id").alias("above_conv"))), "group")
        dealt = dealt.withColumnRenamed("group", "above").join(here, "conv_id")
        open_ = cut(dealt.withColumn("group", F.unhex(F.sha2(F.concat("above", "digest"), 256))).drop("digest"))
        depth += 1

    # Back up: what stands below each group that was dealt out again.
    nodes, below = [d for d in done if d is not None], done[depth]
    for level in range(depth - 1, -1, -1):
        tops = split[level]
        if below is not None:
            told = below.where("above is not null").groupBy(F.col("above").alias("group")).agg(
                F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")
            )
            tops = tops.join(told, "group", "left")
        else:
            tops = tops.withColumn("n_children", F.lit(None).cast("long"))
            tops = tops.withColumn("n_leaves", F.col("n_children")).withColumn("saved", F.col("n_children"))
        tops = cut(
            tops.select(
                "conv_id",
                F.lit(level).cast("long").alias("depth"),
                F.col("above_conv").alias("parent_conv_id"),
                "n_convs",
                F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
                (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
                F.coalesce("ends", nobody).alias("ends_sha256"),
                "above",
            )
        )
        nodes.append(tops)
        below = tops if done[level] is None else tops.unionByName(done[level])
    if not nodes:
        return found.sparkSession.createDataFrame([], NODE)
    result = nodes[0]
    for more in nodes[1:]:
        result = result.unionByName(more)
    return result.drop("above")


#: Conversations rebuilt with borrowed heads, as the query has them.
HEAD, STEP = 8, 5


def rebuilt(found: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of c - c % 5, h = crc32(c) % 9, in place of its own first h."""
    conv = F.col("conv_id")
    return with_heads_of(found, conv - conv % STEP, F.crc32(conv.cast("string")) % (HEAD + 1), HEAD)


#: The query's rows: sums of a subtree are sums over a node's members of what their representatives were given.
ORACLE = """
WITH crcs AS (
    SELECT list(c ORDER BY n) AS t FROM (
        SELECT n, list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), n) AS c
        FROM (SELECT unnest(range(256)) AS n)
    )
),
t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos, digest, n_bytes
    FROM (
        SELECT conv_id, turn, strlen(coalesce(text, '')) AS n_bytes,
            sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL
    )
),
c AS (
    SELECT conv_id, xor(4294967295, list_reduce(
            list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
            lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), CAST(4294967295 AS BIGINT))) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM t), crcs
),
r AS (
    SELECT c.conv_id, b.pos, digest, n_bytes FROM c JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 5 AND b.pos <= c.h
    UNION ALL
    SELECT t.conv_id, pos, digest, n_bytes FROM t JOIN c ON c.conv_id = t.conv_id WHERE pos > c.h
),
m AS (
    SELECT conv_id, 0 AS depth, '' AS key, 0 AS n_bytes FROM c
    UNION ALL
    SELECT conv_id, row_number() OVER own AS depth, sha256(string_agg(digest, '') OVER own) AS key, n_bytes
    FROM r WINDOW own AS (PARTITION BY conv_id ORDER BY pos)
),
placed AS (
    SELECT *, lead(key) OVER (PARTITION BY conv_id ORDER BY depth) AS below,
        lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS above,
        min(conv_id) OVER (PARTITION BY depth, key) AS rep, count(*) OVER (PARTITION BY depth, key) AS n_convs
    FROM m
),
given AS (
    SELECT *, lag(rep) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
        CASE WHEN rep = conv_id THEN (n_convs - 1) * n_bytes ELSE 0 END AS saves,
        CASE WHEN rep = conv_id AND below IS NULL AND count(below) OVER (PARTITION BY depth, key) = 0 THEN 1 ELSE 0 END AS leaf
    FROM placed
),
summed AS (
    SELECT *, sum(saves) OVER down AS saved, sum(leaf) OVER down AS leaves
    FROM given WINDOW down AS (PARTITION BY conv_id ORDER BY depth DESC)
)
SELECT rep AS conv_id, depth, any_value(parent) AS parent_conv_id, CAST(count(*) AS BIGINT) AS n_convs,
    CAST(count(DISTINCT below) AS BIGINT) AS n_children, CAST(sum(leaves) AS BIGINT) AS n_leaves,
    CAST(sum(saved) AS BIGINT) AS saved_tokens,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE below IS NULL), '')) AS ends_sha256
FROM summed GROUP BY depth, key, rep
"""
