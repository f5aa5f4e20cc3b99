"""Operator 5: benchmark decontamination by size-partitioned MinHash containment search.

An item of n distinct shingles is contained to the share t in a document if at least
need = ceil(t n) of its shingles occur there. So each choice of n - need + 1 of its shingles
holds one that occurs. Items are partitioned by n, and each partition has its own k = n - need
+ 1: an item's signature is its bottom-k MinHash, the k smallest hashes, those first that
fewer items share, each kept with the item and its n. A document is searched in the partitions
whose need its own number of shingles reaches; where it meets a value of a signature, it and
the item are a candidate pair, however long the document is, and no item of the required
containment can be missed. Candidate pairs are verified on the exact shingle strings.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fits, small

#: What tells documents apart: rows alike in id and text are one.
KEY = ["known", "id", "mark"]


def words(text: Column) -> Column:
    """Lower-case words of letters and digits; null and empty texts have none."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _grams(rows: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """One row per position of a run of ``size`` words, repeats included; w is the word array."""
    at = F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("at")
    return rows.where(F.size("w") >= size).select(*keep, "w", at)


def _parts(size: int) -> list[Column]:
    return [F.get(F.col("w"), F.col("at") + i) for i in range(size)]


def _shingles(rows: DataFrame, size: int, keep: list[str]) -> DataFrame:
    return _grams(rows, size, keep).select(*keep, F.concat_ws(" ", *_parts(size)).alias("shingle"))


def item_shingles(items: DataFrame, size: int = 5) -> DataFrame:
    """(item_id, width, shingle), each once. An item of fewer than ``size`` words is one shingle of all its words."""
    rows = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("width", F.least(F.size("w"), F.lit(size)))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("width"))).alias("at")
    cell = F.array_join(F.slice("w", F.col("at") + 1, F.col("width")), " ")
    return rows.select("item_id", "w", "width", at).select("item_id", "width", cell.alias("shingle")).distinct()


def signatures(wanted: DataFrame, share: float = 0.8) -> DataFrame:
    """(n, k, item_id, need, width, h): each item's signature in its partition n, from ``item_shingles``."""
    shared = wanted.groupBy("width", "shingle").agg(F.count("*").alias("items"))
    told = wanted.join(shared, ["width", "shingle"]).groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("items", F.xxhash64("shingle").alias("h"), "width"))).alias("order"),
        F.count("*").alias("n"),
    )
    told = told.withColumn("need", F.ceil(F.lit(share) * F.col("n") - F.lit(1e-9))).withColumn("k", F.col("n") - F.col("need") + 1)
    picked = told.select("n", "k", "item_id", "need", F.explode(F.slice("order", F.lit(1), F.col("k").cast("int"))).alias("own"))
    return picked.select("n", "k", "item_id", "need", "own.width", "own.h")


def contained(docs: DataFrame, items: DataFrame, size: int = 5, share: float = 0.8) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_found, containment) with containment >= share.

    docs has doc_id and text, items has item_id and text; other columns are ignored. An item of
    fewer than ``size`` words is one shingle of all its words; an item without words or without
    an id is never found. Repeated item ids are searched as one item with the shingles of all
    its rows. Rows of docs that are alike in id and text are one document; every other row is
    judged by its own text, so that an id with several texts (or null) may be answered several
    times. Null and empty texts contain nothing; of empty tables nothing comes.
    """
    wanted = cut(item_shingles(items, size))
    widths = sorted(r["width"] for r in wanted.select("width").distinct().collect())  # at most ``size``
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_shingles bigint, n_found bigint, containment double")
    lookup = small(cut(signatures(wanted, share)))
    base = docs.select(
        F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")).alias("id"),
        F.xxhash64("text").alias("mark"), "text",
    )
    split = base.select(*KEY, words(F.col("text")).alias("w"))
    met = None
    for width in widths:
        grams = _grams(split, width, KEY).select(*KEY, F.size("w").alias("m"), F.xxhash64(F.concat_ws(" ", *_parts(width))).alias("h"))
        own = lookup.where(F.col("width") == width).select("h", "item_id", "need")
        hit = grams.join(own, "h").where(F.col("m") - width + 1 >= F.col("need")).select(*KEY, "item_id")
        met = hit if met is None else met.unionByName(hit)
    pairs = cut(met.distinct())

    # Verification: shingle strings of the items that lie in the candidates, as one set a document.
    again = cut(pairs.select(*KEY).distinct())
    if fits(again):  # else all documents pass by once more, rather than be shuffled
        base = base.join(F.broadcast(again), KEY, "left_semi")
    split = base.select(*KEY, words(F.col("text")).alias("w"))
    strings = small(cut(wanted.select("width", "shingle").distinct()))
    there = None
    for width in widths:
        own = strings.where(F.col("width") == width).select("shingle")
        hit = _shingles(split, width, KEY).join(own, "shingle", "left_semi")
        there = hit if there is None else there.unionByName(hit)
    there = there.groupBy(*KEY).agg(F.collect_set("shingle").alias("there"))
    total = small(cut(wanted.groupBy("item_id").agg(F.collect_set("shingle").alias("all"))))
    found = pairs.join(there, KEY).join(total, "item_id")
    found = found.select("known", "id", "item_id", F.size("all").cast("bigint").alias("n_shingles"), F.size(F.array_intersect("all", "there")).cast("bigint").alias("n_found"))
    return found.where(F.col("n_found") >= F.ceil(F.lit(share) * F.col("n_shingles") - F.lit(1e-9))).select(
        F.when(F.col("known"), F.col("id")).alias("doc_id"),
        F.col("item_id").cast("bigint").alias("item_id"),
        "n_shingles",
        "n_found",
        (F.col("n_found") / F.col("n_shingles")).alias("containment"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents)
), i AS (
  SELECT item_id, w, least(len(w), 5) AS size FROM (
    SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
    FROM benchmark WHERE item_id IS NOT NULL
  ) WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT item_id, size, array_to_string(w[pos:(pos + size - 1)], ' ') AS shingle
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM i)
), total AS (
  SELECT item_id, count(DISTINCT shingle) AS n FROM wanted GROUP BY item_id
), there AS (
  SELECT DISTINCT r, doc_id, array_to_string(w[pos:(pos + size - 1)], ' ') AS shingle
  FROM (SELECT r, doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM i))
)
SELECT doc_id, item_id, n AS n_shingles, n_found, n_found / n AS containment
FROM (
  SELECT r, doc_id, item_id, count(DISTINCT shingle) AS n_found FROM there JOIN wanted USING (shingle) GROUP BY r, doc_id, item_id
) JOIN total USING (item_id)
WHERE n_found >= ceil(0.8 * n - 1e-9)
"""
