"""Sessions with keyed state: what a history holds is asked by key and never read back from its table (ST1-ST4, ST6).

Each history is a key of ``transformWithState``, in RocksDB: its count and last sequence beside
the ids, sequences and digests of its latest records, all one value, since every call for state
is a message to the JVM; of the others the digest and sequence of each id and the id at each
sequence. A micro-batch touches the state of its own histories only. Records may come late and
out of order; nothing expires.

Within a batch a history's records are taken all or none. A record that is there already
changes nothing. One that takes a taken id or sequence refuses all that the batch has for its
history, and so do more records than a history may have; what is refused is written beside
what is accepted, and the state stays as it was.

Records lie in a table by bucket of their history and batch. Results are compiled again for
the histories a batch has touched, from their buckets alone, and appended with the batch's
number; of each history the latest batch counts, so a result is replaced when its batch is
there as a whole and not before.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as tx

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
BUCKETS = 64
MOST = 100_000
#: Records that lie beside a history's count; with more, all of them go to entries of their own.
RECENT = 64
#: Why a batch's records of a history are refused.
TOO_MANY, NO_ID, ID_TAKEN, SEQUENCE_TAKEN = REASONS = "too_many_records", "missing_id", "id_collision", "sequence_collision"


def digest(columns: list[str]) -> Column:
    """The digest of a record without its place: same id and same digest is the same record delivered again."""
    return tx.hash_of(*[F.col(f"`{c}`") for c in sorted(columns) if c not in ("history_id", "sequence")])


class Session(StatefulProcessor):
    """The state of one history. Rows out: the record with its sequence, and a code where it is refused."""

    def __init__(self, most: int = MOST):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        at, by, told = StructField("sequence", LongType()), StructField("source_id", StringType()), StructField("digest", StringType())
        recent = [StructField(f"recent_{f.name}", ArrayType(f.dataType)) for f in (by, at, told)]
        self.held = handle.getValueState("held", StructType([StructField("n", LongType()), StructField("last", LongType()), *recent]))
        self.ids = handle.getMapState("ids", StructType([by]), StructType([at, told]))
        self.places = handle.getMapState("places", StructType([at]), StructType([by]))

    def _known(self, source_id: str) -> tuple | None:
        return tuple(self.ids.getValue((source_id,))) if self.ids.containsKey((source_id,)) else None

    def _head(self) -> tuple[int, int, list]:
        """How many records there are, their last sequence, and the latest ones as (source_id, sequence, digest)."""
        found = self.held.get()
        return (0, -1, []) if found is None else (found[0], found[1], list(zip(*found[2:], strict=True)))

    def size(self) -> tuple[int, int]:
        """How many records there are, and their last sequence."""
        return self._head()[:2]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # What a history may hold bounds what is kept here; the rest is refused as it comes.
        taken, over = [], False
        for row in rows:
            if len(taken) > 2 * self.most:
                over = True
                yield Row(**{**row.asDict(), "code": TOO_MANY})
            else:
                taken.append(row)
        code, fresh = (NO_ID, []) if key[0] is None else (TOO_MANY, []) if over else self.take(taken)
        names = taken[0].__fields__
        told, at = Row(*names, "code"), names.index("sequence")
        if code is not None:
            yield from (told(*row, code) for row in taken)
        else:
            yield from (told(*row[:at], place, *row[at + 1 :], None) for row, place in fresh)

    def take(self, taken: list[Row]) -> tuple[str | None, list[tuple[Row, int]]]:
        """Takes all records that are new, with their sequences; or none, with the first of REASONS that holds."""
        n, last, recent = self._head()
        near, near_at = {r[0]: (r[1], r[2]) for r in recent}, {r[1]: r[0] for r in recent}
        more = n > len(recent)
        codes = {NO_ID for row in taken if row["source_id"] is None}
        taken = [row for row in taken if row["source_id"] is not None]
        order = lambda r: (r["sequence"] is None, r["sequence"] or 0, r["source_id"] or "", r["digest"])
        fresh: dict[str, tuple] = {}
        places: dict[int, str] = {}
        out, top = [], last
        for row in sorted(taken, key=order):
            own, place = row["source_id"], row["sequence"]
            known = fresh.get(own) or near.get(own) or (self._known(own) if more else None)
            if known is not None:
                if known[1] != row["digest"] or place is not None and known[0] != place:
                    codes.add(ID_TAKEN)
                continue
            place = top + 1 if place is None else place
            there = places.get(place, near_at.get(place))
            if there is None and more and place <= last and self.places.containsKey((place,)):
                there = self.places.getValue((place,))[0]
            if there is not None:
                codes.add(SEQUENCE_TAKEN)
                continue
            fresh[own], places[place] = (place, row["digest"]), own
            top = max(top, place)
            out.append((row, place))
        if n + len(fresh) > self.most:
            codes.add(TOO_MANY)
        if codes:
            return min(codes, key=REASONS.index), []
        if fresh:
            recent += [(own, *told) for own, told in fresh.items()]
            if len(recent) > RECENT:
                for own, place, told in recent:
                    self.ids.updateValue((own,), (place, told))
                    self.places.updateValue((place,), (own,))
                recent = []
            self.held.update((n + len(fresh), top, *([r[k] for r in recent] for k in range(3))))
        return None, out

    def close(self) -> None:
        pass


def bucket(history: Column) -> Column:
    return F.pmod(F.hash(history), F.lit(BUCKETS))


def ingest(stream: DataFrame, table: str, checkpoint: str, on_change: Callable[[DataFrame, int], DataFrame] | None = None, most: int = MOST) -> None:
    """Runs a stream of records (history_id, source_id, sequence and any others) to its end.

    Below ``table``: records and refused, by batch, and compiled with what ``on_change`` makes
    of all records of the histories that a batch has changed. A batch that is run again after a
    failure writes the same rows in the same place. The state is in ``checkpoint``, so a later
    call goes on from there. Records without history or id are refused.
    """
    spark = stream.sparkSession
    columns = stream.columns
    if "digest" in columns or "code" in columns:
        raise ValueError("records cannot have columns named digest or code")
    schema = StructType([*stream.schema.fields, StructField("digest", StringType()), StructField("code", StringType())])
    told = stream.withColumn("digest", digest(columns)).groupBy("history_id").transformWithState(Session(most), schema, "append", "none")

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("bucket", bucket(F.col("history_id"))).persist()
        try:
            fresh = batch.where("code is null").select(*columns, "bucket")
            _replace(fresh, f"{table}/records", number)
            _replace(batch.where("code is not null").select(*columns, "code", "bucket"), f"{table}/refused", number)
            if on_change is not None:
                touched = fresh.select("history_id", "bucket").distinct()
                own = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # BUCKETS at most
                now = stored(spark, table, stream.schema, number, own)
                made = on_change(now.join(touched.drop("bucket"), "history_id", "left_semi"), number)
                # Dealt out by bucket, lest each task write a file for each of them.
                _replace(made.withColumn("bucket", bucket(F.col("history_id"))).repartition("bucket"), f"{table}/compiled", number)
                # A history whose result has no rows is replaced as well.
                _replace(touched.repartition("bucket"), f"{table}/touched", number)
        finally:
            batch.unpersist()

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        told.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _replace(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    whole = StructType([*schema.fields, StructField("batch", IntegerType()), StructField("bucket", IntegerType())])
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(path)


def stored(spark: SparkSession, table: str, schema: StructType, batch: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The records accepted up to a batch; only the folders of the buckets given are read."""
    rows = _read(spark, f"{table}/records", schema)
    rows = rows if batch is None else rows.where(F.col("batch") <= batch)
    return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("batch", "bucket")


def refused(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The records refused, with code and batch."""
    return _read(spark, f"{table}/refused", StructType([*schema.fields, StructField("code", StringType())])).drop("bucket")


def compiled(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """ST2: the current results: of each history those of the last batch that touched it."""
    touched = _read(spark, f"{table}/touched", StructType([StructField("history_id", StringType())]))
    last = touched.groupBy("history_id").agg(F.max("batch").alias("batch"), F.count("*").alias("n_compiled"))
    return _read(spark, f"{table}/compiled", schema).drop("bucket").join(last, ["history_id", "batch"])


# ---- staged commits (ST4) ----


class Conflict(ValueError):
    """Another writer has committed in between."""


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole, unless there is one: under a name of its own first, then renamed, which one of two rivals wins."""
    files, place = _file_system(spark, path)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{spark._jvm.java.util.UUID.randomUUID()}")
    if files.exists(place):
        return False
    out = files.create(own, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(own, place, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as error:  # the rival's file is there
        if "FileAlreadyExists" not in str(error):
            raise
        files.delete(own, False)
        return False


def version(spark: SparkSession, table: str) -> int:
    """The last version committed; 0 for none. Versions are told by their files, one each."""
    files, place = _file_system(spark, f"{table}/versions")
    if not files.exists(place):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def manifest(spark: SparkSession, table: str, number: int) -> dict:
    if number == 0:
        return {"version": 0, "parts": [], "archive_head": None}
    return json.loads("".join(r["value"] for r in spark.read.text(f"{table}/versions/{number}").collect()))


def stage(rows: DataFrame, table: str) -> str:
    """Writes rows where no reader looks; the name of the part."""
    name = str(rows.sparkSession._jvm.java.util.UUID.randomUUID())
    rows.write.parquet(f"{table}/parts/{name}")
    return name


def commit(spark: SparkSession, table: str, part: str, base: int, archive_head: str | None = None) -> int:
    """Makes a staged part the next version after ``base``; Conflict if that is not the last one any more.

    A table belongs to one archive: once a version names a head, later ones must name one as
    well, and no two versions the same.
    """
    held = manifest(spark, table, base)
    if held["archive_head"] is not None and archive_head is None:
        raise ValueError("the table is bound to an archive; a commit must name its head")
    if archive_head is not None and archive_head in held.get("heads", []):
        raise ValueError("another version is bound to that head of the archive")
    heads = [*held.get("heads", []), *([archive_head] if archive_head else [])]
    told = {"version": base + 1, "parts": [*held["parts"], part], "archive_head": archive_head, "heads": heads}
    if version(spark, table) != base or not _put_new(spark, f"{table}/versions/{base + 1}", json.dumps(told, sort_keys=True)):
        raise Conflict(f"version {base + 1} was committed by another writer")
    return base + 1


def at_version(spark: SparkSession, table: str, schema: StructType, number: int | None = None) -> DataFrame:
    """The rows of a version, the last one by default: those of its parts, whole."""
    parts = manifest(spark, table, version(spark, table) if number is None else number)["parts"]
    return spark.read.schema(schema).parquet(*[f"{table}/parts/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)
