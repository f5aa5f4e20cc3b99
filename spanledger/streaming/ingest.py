"""Incremental ingestion as a stream (ST1, ST2, parts of ST3 and ST6).

Records may arrive late and out of order within their history, so nothing expires and a
touched history is compiled again from its records. Redelivered records change nothing; a
record that takes a taken id or sequence fails the batch before anything is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import archive


def ingest(stream: DataFrame, table: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None):
    """Starts a query that appends a stream of records to the Parquet table at ``table``.

    After each batch ``on_change`` gets all records of the histories it touched, and the
    batch's number. A batch that is run again after a failure overwrites its own part.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        held = stored(spark, table, batch.schema, before=number)
        fresh = archive.append(held, numbered(batch, held))
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if on_change is not None:
            touched = spark.read.schema(batch.schema).parquet(f"{table}/batch={number}").select("history_id").distinct()
            now = stored(spark, table, batch.schema, before=number + 1)
            on_change(now.join(touched, "history_id", "left_semi"), number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered(batch: DataFrame, held: DataFrame) -> DataFrame:
    """ST1: records without a sequence follow the highest one of their history, held or in the batch, in the order of their ids.

    One that was held before, by its id, keeps the sequence it got then; equal rows of the batch are one.
    """
    known = held.select("history_id", "source_id", F.col("sequence").alias("_held"))
    last = held.select("history_id", "sequence").unionByName(batch.select("history_id", "sequence")).groupBy("history_id").agg(F.coalesce(F.max("sequence"), F.lit(-1)).alias("_last"))
    rows = batch.dropDuplicates([c for c in archive.RECORD + ["history_id"] if c in batch.columns]).join(known, ["history_id", "source_id"], "left")
    rows = rows.withColumn("sequence", F.coalesce("sequence", "_held")).join(last, "history_id", "left")
    place = F.row_number().over(Window.partitionBy("history_id", F.col("sequence").isNull()).orderBy("source_id"))
    return rows.withColumn("sequence", F.coalesce("sequence", F.col("_last") + place).cast(batch.schema["sequence"].dataType)).select(*batch.columns)


def stored(spark: SparkSession, table: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The records ingested so far, without those of batch ``before`` and later."""
    empty = spark.createDataFrame([], schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return empty
    whole = StructType([*schema.fields, StructField("batch", IntegerType())])
    rows = spark.read.schema(whole).option("basePath", table).parquet(table)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def windows(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """An extension: counts by event type and tumbling window; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
