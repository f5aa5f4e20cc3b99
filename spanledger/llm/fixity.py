"""Operator 2: Merkle fixity audit of WARC records.

Records are hashed where they lie. Ordered ranges of record numbers, which are ordered ranges
of offsets in the archive, are hashed into a tree: a node's digest covers its children's
digests in order, and the node knows how many bytes and records lie below it. Two replicas
are compared from the roots down; at each level only the children of nodes that differ are
compared, though the level, a row for each node, is scanned to find them. Offsets are found on the same way, from the sizes of the siblings before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: log2 of the children of a node.
FANOUT = 8
#: Record number of rows whose key is null.
NO_KEY = -(1 << 62)


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record; a missing url or html leaves its header out."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\n"),
        F.when(url.isNull(), F.lit("")).otherwise(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))),
        F.when(html.isNull(), F.lit("")).otherwise(F.lit("Content-Type: text/html\r\n")),
        F.lit("Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame, key: str, record: Column) -> DataFrame:
    """One leaf per record number: node, digest, n_bytes, n_records.

    Rows that repeat a number form one leaf, whose digest is that of the sum of the rows'
    hashes in five slices: it needs no order and is summed map-side, and corruption is located
    no closer than the number. Rows without a number share one that stands before all others. A
    null record counts as an empty one; a record of any length is hashed where it lies. Other
    columns are ignored; no rows give no leaves.
    """
    record = F.coalesce(record.cast("binary"), F.lit(b""))
    hashed = records.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("node"),
        F.sha2(record, 256).alias("h"),
        F.octet_length(record).cast("long").alias("size"),
    )
    slices = [F.conv(F.substring("h", 1 + 13 * k, 13), 16, 10).cast("decimal(38,0)") for k in range(5)]
    summed = hashed.groupBy("node").agg(
        *[F.sum(s).alias(f"s{k}") for k, s in enumerate(slices)],
        F.sum("size").alias("n_bytes"),
        F.count("*").alias("n_records"),
        F.min("h").alias("h"),
    )
    many = F.sha2(F.concat_ws(":", "n_records", *[F.col(f"s{k}").cast("string") for k in range(5)]), 256)
    return summed.select("node", F.when(F.col("n_records") == 1, F.col("h")).otherwise(many).alias("digest"), "n_bytes", "n_records")


def tree(level0: DataFrame, height: int) -> list[DataFrame]:
    """Levels 0 (leaves) to height (one root); node k of a level covers the children k * 2**FANOUT and on."""
    levels = [cut(level0)]
    for _ in range(height):
        below = levels[-1]
        grouped = below.groupBy(F.shiftright("node", FANOUT).alias("node")).agg(
            F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("children"),
            F.sum("n_bytes").alias("n_bytes"),
            F.sum("n_records").alias("n_records"),
        )
        text = F.array_join(F.transform("children", lambda c: F.concat(c["node"].cast("string"), F.lit("="), c["digest"])), ";")
        levels.append(cut(grouped.select("node", F.sha2(text, 256).alias("digest"), "n_bytes", "n_records")))
    return levels


def height_of(*sides: DataFrame) -> int:
    """Levels above the leaves until one node covers all of every side."""
    low, high = [], []
    for side in sides:
        r = side.agg(F.min("node").alias("a"), F.max("node").alias("b")).first()
        if r["a"] is not None:
            low.append(r["a"])
            high.append(r["b"])
    height = 0
    while low and (min(low) >> (FANOUT * height)) != (max(high) >> (FANOUT * height)):
        if FANOUT * height >= 64:  # both signs: -1 and 0 are the two roots
            break
        height += 1
    return height


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Leaves that differ between two replicas' leaf tables.

    node, status (altered, missing in the right replica, or extra there), start (offset in the
    left replica of the record or of where it would stand), n_bytes, digest and other_digest.
    Equal replicas give no rows, nor do two empty ones; of a replica beside an empty one every
    record is missing or extra.
    """
    left, right = cut(left), cut(right)
    height = height_of(left, right)
    ours, theirs = tree(left, height), tree(right, height)
    above = None
    for level in range(height, -1, -1):
        a, b = ours[level], theirs[level]
        parent = F.shiftright("node", FANOUT).alias("parent")
        a, b = a.select("*", parent), b.select("node", F.col("digest").alias("other_digest"), parent.alias("other_parent"))
        if above is None:
            a = a.withColumn("from", F.lit(0).cast("long"))
        else:
            near = small(above)  # few nodes differ: then the others of a level are passed over where they lie
            a = a.join(near.select(F.col("node").alias("parent"), F.col("start").alias("from")), "parent")
            b = b.join(near.select(F.col("node").alias("other_parent")), "other_parent")
        both = a.join(b, "node", "full_outer").withColumn("parent", F.coalesce("parent", "other_parent"))
        if above is not None:  # a node of the right replica only takes its start from its parent
            both = both.join(near.select(F.col("node").alias("parent"), F.col("start").alias("own")), "parent").withColumn("from", F.coalesce("from", "own")).drop("own")
        before = F.sum(F.coalesce("n_bytes", F.lit(0))).over(Window.partitionBy("parent").orderBy("node"))
        if above is None:
            before = F.sum(F.coalesce("n_bytes", F.lit(0))).over(Window.orderBy("node"))
        placed = both.withColumn("start", F.coalesce("from", F.lit(0)) + before - F.coalesce("n_bytes", F.lit(0)))
        above = cut(placed.where(~F.col("digest").eqNullSafe(F.col("other_digest"))).select("node", "digest", "other_digest", "n_bytes", "start"))
    status = F.when(F.col("other_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("altered")
    return above.select("node", status.alias("status"), "start", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), "digest", "other_digest")


def replica_with_faults(pages: DataFrame) -> DataFrame:
    """A replica as the query audits it: of each 50 pages one altered and one lost."""
    kept = pages.where("page_id is null or page_id % 50 <> 8")
    altered = kept.withColumn("html", F.when(F.col("page_id") % 50 == 7, F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html")))
    return altered


ORACLE = r"""
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) AS head,
         CASE WHEN url IS NULL THEN '' ELSE 'WARC-Target-URI: ' || url || chr(13) || chr(10) END
         || CASE WHEN html IS NULL THEN '' ELSE 'Content-Type: text/html' || chr(13) || chr(10) END || 'Content-Length: ' AS more,
         coalesce(html, '') AS body,
         coalesce(html, '') || CASE WHEN page_id % 50 = 7 THEN '!' ELSE '' END AS other
  FROM pages
), s AS (
  SELECT page_id,
         head || more || octet_length(encode(body)) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS rec,
         head || more || octet_length(encode(other)) || chr(13) || chr(10) || chr(13) || chr(10) || other || chr(13) || chr(10) || chr(13) || chr(10) AS rec2
  FROM r
), p AS (
  SELECT *, octet_length(encode(rec)) AS n_bytes,
         sum(octet_length(encode(rec))) OVER (ORDER BY page_id) - octet_length(encode(rec)) AS start
  FROM s
)
SELECT page_id AS node, CASE WHEN page_id % 50 = 8 THEN 'missing' ELSE 'altered' END AS status,
       CAST(start AS BIGINT) AS start, CAST(n_bytes AS BIGINT) AS n_bytes, sha256(rec) AS digest,
       CASE WHEN page_id % 50 = 8 THEN NULL ELSE sha256(rec2) END AS other_digest
FROM p WHERE page_id % 50 IN (7, 8)
"""
