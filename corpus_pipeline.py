"""A corpus pipeline of the operators in spanledger.llm, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes what a stage
returns as Parquet and gives it to the next. All stages but the last return documents with
the columns they came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.llm import decontam, exact_dedup, packing, quality, simhash
from spanledger.llm.common import cut, field, fresh_dir, small

#: A classifier is learned on the way, which SQL does not express.
ORACLE_SQL = None


def _row(docs: DataFrame):
    """All columns as one struct, whose fields clash with nothing that an operator adds."""
    return F.struct(*[field(c) for c in docs.columns]).alias("row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is learned from `labels` outside the held-out fold.

    Null texts are judged as empty ones. Where no document has a label nothing is learned and
    nothing rejected.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not quality.learned(model):
        return docs
    return quality.rate(docs.select("text", _row(docs)), model).where("predicted = 1").select("row.*")


def _numbered(docs: DataFrame) -> DataFrame:
    """(number, row): each row of docs under a number of its own; written, so that a row keeps it."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "numbered")
    docs.select(F.monotonically_increasing_id().alias("number"), _row(docs)).write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def _texts(numbered: DataFrame) -> DataFrame:
    """Numbered documents as operators take them, by their number for the id."""
    return numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text"))


def _without(numbered: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered documents but for the given numbers; the numbers are broadcast where they are few."""
    return numbered.join(small(cut(gone)), "number", "left_anti").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the most code points, then the smallest doc_id, null last."""
    numbered = _numbered(docs)
    found = exact_dedup.exact_dedup(numbered.select("number", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")), carry=["number"])
    return _without(numbered, found.where(~F.col("kept")).select("number"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, null last; any one of equal ids."""
    numbered = _numbered(docs)
    groups = simhash.near_groups(_texts(numbered)).select(F.col("doc_id").alias("number"), "component_id")
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").cast("long").alias("id"), "number")
    placed = cut(groups.join(numbered.select("number", order.alias("order")), "number").select("component_id", "order"))
    stay = placed.groupBy("component_id").agg(F.min("order").alias("first"))
    gone = placed.join(stay, "component_id").where(F.col("order.number") != F.col("first.number"))
    return _without(numbered, gone.select("order.number"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of `benchmark`, each row judged by its own text."""
    numbered = _numbered(docs)
    leaks = decontam.contained(_texts(numbered), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(numbered, leaks.select(F.col("doc_id").alias("number")).distinct())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot."""
    return packing.pack(docs, packing.n_words(F.col("text")))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: where each document that they leave is packed.

    Documents are judged row by row: null and repeated ids, null and empty texts are rows like
    any others (an empty text is a copy of every other empty text). Columns of any names pass
    through all stages but the last. Of an empty table nothing comes.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
