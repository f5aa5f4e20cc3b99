"""Hash-chained archive of records: append, chain, verify, resolve, upgrade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

RECORD = ["source_id", "sequence", "role", "content", "timestamp", "metadata"]


def record_hash(columns: list[str]) -> Column:
    """The record's own digest, over whichever of RECORD there are."""
    return tx.hash_of(*[F.col(c) for c in RECORD if c in columns])


def append(archive: DataFrame, incoming: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """A1: rows of incoming that are new. Redelivered rows are left out; a row that takes an id or a
    sequence that is taken by a different record fails the job. With expected heads (history_id,
    head) the archive must end as the caller believes, else nothing is appended.
    """
    if expected is not None and (moved := verify_heads(archive, expected).take(10)):
        raise ValueError("unexpected head in " + ", ".join(r["history_id"] for r in moved))
    held = archive.select("history_id", "source_id", "sequence", record_hash(archive.columns).alias("held"))
    rows = incoming.withColumn("_own", record_hash(incoming.columns)).dropDuplicates(["history_id", "_own"])
    within = rows.groupBy("history_id", "source_id").agg(F.count("*").alias("n")).where("n > 1").select("history_id", F.lit("id").alias("by"))
    within = within.unionByName(rows.groupBy("history_id", "sequence").agg(F.count("*").alias("n")).where("n > 1").select("history_id", F.lit("sequence").alias("by")))
    clash = within.groupBy("history_id").agg(F.max("by").alias("clash"))
    by_id = held.select("history_id", "source_id", F.col("held").alias("id_held"))
    by_sequence = held.select("history_id", "sequence", F.col("held").alias("sequence_held"))
    joined = rows.join(by_id, ["history_id", "source_id"], "left").join(by_sequence, ["history_id", "sequence"], "left").join(clash, "history_id", "left")
    taken = F.coalesce((F.col("id_held") != F.col("_own")) | (F.col("sequence_held") != F.col("_own")), F.lit(False)) | F.col("clash").isNotNull()
    # One expression, so that no part of it is applied before the other.
    fresh = F.when(taken, F.raise_error(F.concat(F.lit("collision in history "), "history_id")).cast("boolean")).otherwise(F.col("id_held").isNull())
    return joined.where(fresh).select(*incoming.columns)


#: Entries that a fold appends to one array before it begins the next.
BLOCK = 128


def _ordered(records: DataFrame) -> DataFrame:
    """history_id and rs: each history's (sequence, source_id, record) in order."""
    rows = records.select("history_id", F.struct("sequence", "source_id", record_hash(records.columns).alias("record")).alias("r"))
    return rows.groupBy("history_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))


def _walk(rs: Column, places: Column, before: Column) -> Column:
    """The last entry over the records at consecutive places, from the entry before them."""
    return F.aggregate(places, before, lambda entry, i: entry_hash(i, entry, F.get(rs, i)["record"]))


def heads(records: DataFrame) -> DataFrame:
    """A2: history_id and head alone. The fold carries one entry, so its cost follows the number of records."""
    head = lambda rs: _walk(rs, F.sequence(F.lit(0), F.size(rs) - 1), F.lit(lx.GENESIS))
    return _ordered(records).select("history_id", tx.bound(F.col("rs"), head).alias("head"))


def chain(records: DataFrame) -> DataFrame:
    """A2: history_id and head, and the chain as entries (position, previous, entry) by sequence.

    An entry's hash covers its position, the entry before and the record, so a history is
    folded in order; histories are independent of each other. What a fold carries is copied at
    every step: a first pass keeps the entry before each block, a second lists every block's
    own entries from there.
    """

    def listed(rs: Column) -> Column:
        places = lambda k: F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, F.size(rs)) - 1)

        def skip(s: Column, k: Column) -> Column:
            return F.struct(_walk(rs, places(k), s["head"]).alias("head"), F.concat(s["starts"], F.array(s["head"])).alias("starts"))

        def link(s: Column, i: Column) -> Column:
            r = F.get(rs, i)
            entry = entry_hash(i, s["head"], r["record"])
            one = F.struct(r["source_id"].alias("source_id"), i.alias("position"), s["head"].alias("previous"), entry.alias("entry"))
            return F.struct(entry.alias("head"), F.concat(s["entries"], F.array(one)).alias("entries"))

        def block(before: Column, k: Column) -> Column:
            none = F.array().cast("array<struct<source_id:string,position:int,previous:string,entry:string>>")
            return F.aggregate(places(k), F.struct(before.alias("head"), none.alias("entries")), link, lambda s: s["entries"])

        first = F.struct(F.lit(lx.GENESIS).alias("head"), F.array().cast("array<string>").alias("starts"))
        starts = F.aggregate(F.sequence(F.lit(0), ((F.size(rs) - 1) / BLOCK).cast("int")), first, skip, lambda s: s["starts"])
        return F.flatten(F.transform(starts, block))

    rows = _ordered(records).select("history_id", tx.bound(F.col("rs"), listed).alias("entries"))
    return rows.select("history_id", F.element_at("entries", -1)["entry"].alias("head"), "entries")


def entry_hash(position: Column, previous: Column, record: Column) -> Column:
    return F.sha2(F.concat_ws(":", position.cast("string"), previous, record).cast("binary"), 256)


def archived(records: DataFrame) -> DataFrame:
    """The archive table: records with position, previous and entry."""
    entries = chain(records).select("history_id", F.explode("entries").alias("e")).select("history_id", "e.*")
    return records.join(entries, ["history_id", "source_id"])


def verify(archive: DataFrame) -> DataFrame:
    """A5: issues of an archive table. Each entry is recomputed by itself; links compare neighbours."""
    order = Window.partitionBy("history_id").orderBy("sequence", "source_id")
    rows = archive.withColumns(
        {
            "_place": F.row_number().over(order) - 1,
            "_before": F.coalesce(F.lag("entry").over(order), F.lit(lx.GENESIS)),
            "_entry": entry_hash(F.col("position"), F.col("previous"), record_hash(archive.columns)),
        }
    )
    rules = F.array(
        F.when(F.col("_place") != F.col("position"), F.lit("position")),
        F.when(F.col("_before") != F.col("previous"), F.lit("link")),
        F.when(F.col("_entry") != F.col("entry"), F.lit("entry")),
    )
    return rows.select("history_id", "source_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("code"))


def verify_heads(archive: DataFrame, expected: DataFrame) -> DataFrame:
    """Histories whose last entry is not the expected head (history_id, head); an absent history counts."""
    last = archive.groupBy("history_id").agg(F.max_by("entry", "position").alias("actual"))
    return expected.join(last, "history_id", "left").where(~F.col("head").eqNullSafe(F.col("actual")))


def resolve_spans(spans: DataFrame, archive: DataFrame) -> DataFrame:
    """Spans (history_id, source_id, start, end) with the text they point to, null if out of range."""
    own = archive.select("history_id", "source_id", "content")
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("content"))
    return spans.join(own, ["history_id", "source_id"], "left").withColumn("quote", F.when(inside, F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")))).drop("content")


def upgrade(table: DataFrame) -> DataFrame:
    """A3: an archive table whose legacy histories, without any position, previous or entry, are chained; chained ones stay as they are.

    A history that is chained in part fails the job.
    """
    links = ["position", "previous", "entry"]
    bare = F.coalesce(*[F.col(c).cast("string") for c in links]).isNull()
    kinds = table.groupBy("history_id").agg(F.every(bare).alias("legacy"), F.every(~bare).alias("chained"))
    mixed = F.raise_error(F.concat(F.lit("chained in part: "), "history_id")).cast("boolean")
    kinds = kinds.select("history_id", F.when(F.col("legacy") | F.col("chained"), F.col("legacy")).otherwise(mixed).alias("legacy"))
    rows = table.join(kinds, "history_id")
    old = rows.where("legacy").drop("legacy", *links)
    return rows.where("not legacy").drop("legacy").unionByName(archived(old).select(*table.columns))
