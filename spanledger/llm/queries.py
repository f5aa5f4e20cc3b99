"""The queries of this subpackage, applied to their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontam, embedding_dedup, exact_dedup, fixity, hard_negatives, langid, packing, prefix_trie, quality, simhash, suffix_dedup,
    token_bits, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    return fixity.audit(
        fixity.leaves(pages, "page_id", record), fixity.leaves(fixity.replica_with_faults(pages), "page_id", record)
    )


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.n_words(F.col("text")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_bits.token_bits(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trie.sequences(prefix_trie.turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(found))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = (F.col("label").cast("long") + 1) % 10
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    found = [
        op1_language_id, op2_warc_fixity, op3_length_buckets, op4_suffix_dedup, op5_decontamination,
        op6_quality, op7_simhash, op8_exact_dedup, op9_token_bits, op10_toxicity,
        op11_prefix_trie, op12_hard_negatives, op13_embedding_dedup,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_fixity": fixity.ORACLE,
        "op5_decontamination": decontam.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op12_hard_negatives": hard_negatives.ORACLE,
        "op13_embedding_dedup": embedding_dedup.ORACLE,
    }
