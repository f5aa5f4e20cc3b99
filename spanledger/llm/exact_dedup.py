"""Operator 8: exact deduplication as a stateful stream.

All rows are written once, normalised, with a locator: the file and place in which a row stands
in that copy. A slim row per document (digest, stable identifier, locator, size) flows from it
through a streaming aggregation whose keyed state lies in RocksDB on disk and never expires.
State per digest: the row that stays, with its locator, and the number of rows seen. A digest
that is held by several rows is a hit: in the same micro-batch the full bytes of its rows are
compared with those found at the locator of the row that stays. Digests under which bytes
differ leave the state's answer, and their rows are grouped by the whole text instead.

Only DataFrame and SQL functions run on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, cut, fits, fresh_dir, small

#: What a micro-batch tells of a digest.
STATE = "digest string, keep struct<points: int, rank: bigint, place: bigint>, n_rows bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _order() -> Column:
    """The largest stays: most code points, then the smallest id (null ids last), then the first in the copy; ~id falls as id rises, for every long."""
    return F.struct(F.col("n_points").alias("points"), F.bitwise_not("doc_id").alias("rank"), (-F.col("locator")).alias("place"))


def fold_stream(slim: DataFrame, content: DataFrame, state_dir: str, out_dir: str) -> None:
    """Run a stream of (digest, doc_id, locator, n_points) into the state below ``state_dir``.

    content holds (digest, locator, body) of every row that was or is streamed: where a locator
    leads. A second call with the same folders continues from the state of the first. Every
    micro-batch writes what changed below ``out_dir``/state, where the row with the largest
    ``n_rows`` of a digest is its current state, and below ``out_dir``/mixed the digests whose
    rows turned out to differ.
    """
    spark = slim.sparkSession
    held = {}
    options = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        # Small stores: no files laid out in advance, and changes uploaded instead of snapshots.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    for key, value in options.items():
        held[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        state = slim.groupBy("digest").agg(F.max(_order()).alias("keep"), F.count("*").alias("n_rows"))

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out_dir}/state/batch={number}")
            hits = spark.read.schema(STATE).parquet(f"{out_dir}/state/batch={number}").where("n_rows > 1")
            hits = hits.select("digest", (-F.col("keep.place")).alias("keep_at"))
            differing(content, hits, f"{out_dir}/members/batch={number}").write.mode("overwrite").parquet(f"{out_dir}/mixed/batch={number}")

        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", state_dir)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in held.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def differing(content: DataFrame, hits: DataFrame, folder: str) -> DataFrame:
    """Digests of hits (digest, keep_at) under which some row's bytes are not those found at keep_at, repeats included.

    Nothing is aggregated above the joins, so Spark may split the largest group.
    """
    hits = cut(hits)
    if fits(hits):
        members = content.join(F.broadcast(hits), "digest")
    else:
        content.join(hits, "digest").write.mode("overwrite").parquet(folder)
        members = content.sparkSession.read.parquet(folder)
    keepers = cut(members.where("locator = keep_at").select("digest", F.col("body").alias("keep_body")))
    return members.join(small(keepers), "digest").where("body <> keep_body").select("digest")


def current_state(spark: SparkSession, out_dir: str) -> DataFrame:
    """The state of every digest after the last batch: digest, keep, n_rows."""
    told = spark.read.schema(STATE).option("recursiveFileLookup", "true").parquet(f"{out_dir}/state")
    return told.groupBy("digest").agg(F.max_by("keep", "n_rows").alias("keep"), F.max("n_rows").alias("n_rows"))


def mixed_digests(spark: SparkSession, out_dir: str) -> DataFrame:
    """Digests under which different bytes were found, each once."""
    return spark.read.schema("digest string").option("recursiveFileLookup", "true").parquet(f"{out_dir}/mixed").distinct()


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the columns named in carry.

    docs needs doc_id (integer) and text; other columns are ignored. Texts are equal when
    identical without ASCII white space, null counting as empty. Of equal texts the row with
    the most code points stays, then the smallest doc_id, a null id last; of rows that are
    alike in that too, one. So exactly one row of each group is kept, and keep_id is null where
    that row has no id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    copy, run = fresh_dir(spark, "dedup-rows"), fresh_dir(spark, "dedup-state")
    body = normalised(F.col("text"))
    docs.select(
        digest(body).alias("digest"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("locator"),  # the number of the file, then that of the row
        F.length(F.coalesce("text", F.lit(""))).alias("n_points"),
        body.alias("body"),
        *carry,
    ).write.option("compression", "zstd").parquet(copy)
    rows = spark.read.parquet(copy)
    slim = spark.readStream.schema(rows.select("digest", "doc_id", "locator", "n_points").schema).parquet(copy)
    fold_stream(slim, rows.select("digest", "locator", "body"), f"{run}/state", f"{run}/out")
    # Cut, so that the joins stand directly on their exchanges and a hot digest can be split.
    state = cut(
        current_state(spark, f"{run}/out").select(
            "digest", F.bitwise_not("keep.rank").alias("keep_id"), (-F.col("keep.place")).alias("keep_at"), F.col("n_rows").alias("group_size")
        )
    )
    told = ["doc_id", "keep_id", "group_size", (F.col("locator") == F.col("keep_at")).alias("kept")]
    mixed = cut(mixed_digests(spark, f"{run}/out"))
    plain = F.col("digest") if digest is sha256 else sha256(F.col("body"))
    if mixed.isEmpty():
        return rows.join(state, "digest").select(*told, plain.alias("text_sha256"), *carry)
    good = rows.join(small(mixed), "digest", "left_anti").join(state, "digest").select(*told, plain.alias("text_sha256"), *carry)
    return good.unionByName(_regroup(rows.join(small(mixed), "digest", "left_semi"), carry))


def _regroup(rows: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Different texts that met under one digest, dealt anew by whole text."""
    best = cut(rows.groupBy("body").agg(F.max(_order()).alias("best"), F.count("*").alias("group_size")))
    return rows.join(best, "body").select(
        "doc_id",
        F.bitwise_not("best.rank").alias("keep_id"),
        "group_size",
        (F.col("locator") == -F.col("best.place")).alias("kept"),
        sha256(F.col("body")).alias("text_sha256"),
        *carry,
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(body) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY body ORDER BY length(text) DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
