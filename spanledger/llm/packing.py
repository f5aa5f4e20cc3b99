"""Operator 3: packing by optimal length buckets.

Dynamic programming over the global histogram of lengths, one entry for each length that
occurs, chooses the bucket boundaries that minimise padding. No bucket holds both lengths
within the token budget and lengths beyond it, so what fits is never padded beyond the budget.
In each bucket every document is padded to the boundary, so a batch holds floor(budget /
boundary) documents; a document longer than the budget is a batch by itself.

The driver holds the histogram: as many entries as there are different lengths, which is
never more than the longest length, and the choices of each layer, four bytes an entry.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, WORD, cut

BUCKETS, BUDGET = 16, 32_768
#: Rows of a bucket that are numbered by one task, about.
SHARD = 20_000


def n_words(text: Column) -> Column:
    """Runs of characters that are no ASCII white space; null and empty texts have 0."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.regexp_replace(marked, WHITE, "")).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int, budget: int | None = None) -> list[int]:
    """Boundaries (ascending, the last one the longest length) of at most so many buckets with the least padding.

    lengths ascend. If some lengths fit the budget and some do not, the longest that fits is a
    boundary, which takes a bucket more if there is only one. Exact, in whole numbers: with
    total[i] rows in the first i lengths, the cost of j lengths in k buckets is the least over
    i of cost[k-1][i] + lengths[j-1] * (total[j] - total[i]). For each i that is a line in
    lengths[j-1]; slopes fall as i grows and lengths grow with j, so a hull of lines gives each
    layer in one pass. Of equal solutions the one with fewer buckets wins.
    """
    n = len(lengths)
    if not n:
        return []
    size = [int(x) for x in lengths]
    total = [0, *np.cumsum(np.asarray(counts, np.int64)).tolist()]
    wall = sum(1 for x in size if budget is not None and x <= budget)
    wall = wall if 0 < wall < n else 0  # a bucket lies on one side of it
    buckets = max(buckets, 2) if wall else buckets
    cost: list[int | None] = [0] + [None] * n
    layers, best, best_k = [], None, 0
    for k in range(1, min(buckets, n) + 1):
        fresh: list[int | None] = [None] * (n + 1)
        origin = np.zeros(n + 1, np.int32)
        hull: list[int] = []
        at = 0
        for j in range(1, n + 1):
            if wall and j == wall + 1:
                hull, at = [], 0
            i, own = j - 1, cost[j - 1]
            if own is not None:
                # The last line goes if the new one meets the line before it no later than the last one does.
                while len(hull) > at + 1:
                    p, q = hull[-2], hull[-1]
                    if (own - cost[p]) * (total[q] - total[p]) > (cost[q] - cost[p]) * (total[i] - total[p]):
                        break
                    hull.pop()
                hull.append(i)
            x = size[j - 1]
            while at + 1 < len(hull) and cost[hull[at + 1]] - x * total[hull[at + 1]] < cost[hull[at]] - x * total[hull[at]]:
                at += 1
            if at < len(hull):
                fresh[j], origin[j] = cost[hull[at]] + x * (total[j] - total[hull[at]]), hull[at]
        layers.append(origin)
        if fresh[n] is not None and (best is None or fresh[n] < best):
            best, best_k = fresh[n], k
        cost = fresh
    out, j = [], n
    for k in range(best_k, 0, -1):
        out.append(size[j - 1])
        j = int(layers[k - 1][j])
    return out[::-1]


def pack(docs: DataFrame, length: Column, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch_id, slot and padding of every row.

    length is not negative; a null one counts as 0. Rows of one bucket are dealt to shards by a
    hash of their place in docs, so that null and repeated ids spread like any others, and take
    their slots there in the order of id and length, null ids first; repeated rows take a slot
    each. batch_id is unique over all buckets. Other columns of docs are ignored, whatever
    their names. Of an empty table nothing comes.
    """
    spark = docs.sparkSession
    place = F.xxhash64(F.monotonically_increasing_id(), F.lit("pack"))
    rows = cut(docs.select("doc_id", F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"), place.alias("place")))
    longer = F.greatest("n_tokens", F.lit(1)).alias("length")  # an empty document is padded to one token
    histogram = sorted((r["length"], r["n"]) for r in rows.groupBy(longer).agg(F.count("*").alias("n")).collect())
    lengths = np.array([x for x, _ in histogram], np.int64)
    counts = np.array([n for _, n in histogram], np.int64)
    bounds = boundaries(lengths, counts, buckets, budget)
    edges = [(k, b, max(1, budget // b)) for k, b in enumerate(bounds)]
    table = F.broadcast(spark.createDataFrame(edges, "bucket int, bucket_len long, capacity long"))
    rows = rows.withColumn("bucket", sum([(F.greatest("n_tokens", F.lit(1)) > b).cast("int") for b in bounds[:-1]], F.lit(0)))
    shards = max(1, int(counts.sum()) // SHARD) if len(counts) else 1
    rows = rows.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    # Ranks in two levels: rows before a shard in its bucket, then the place within the shard.
    sizes = cut(rows.groupBy("bucket", "shard").agg(F.count("*").alias("n")))
    before = sizes.select(
        "bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before")
    )
    full = cut(sizes.groupBy("bucket").agg(F.sum("n").alias("n")).join(table, "bucket"))
    first = full.select(
        "bucket", "bucket_len", "capacity",
        (F.sum(F.ceil(F.col("n") / F.col("capacity"))).over(Window.orderBy("bucket")) - F.ceil(F.col("n") / F.col("capacity"))).alias("first"),
    )
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")) - 1
    ranked = rows.drop("place").withColumn("place", place).join(before, ["bucket", "shard"]).join(F.broadcast(first), "bucket")
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place"))
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        (F.col("first") + F.floor(F.col("rank") / F.col("capacity"))).cast("long").alias("batch_id"),
        (F.col("rank") % F.col("capacity")).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
