"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs in one process."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spanledger-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once, keep in the shared folder and drop the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def field(name: str) -> Column:
    """A column by its whole name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows and bytes of texts up to which a table is broadcast.
FEW, SLIGHT = 200_000, 1 << 25


def fits(rows: DataFrame, most_rows: int = FEW, most_bytes: int = SLIGHT) -> bool:
    """Whether a table that is computed already is small enough to broadcast: by its rows and the bytes of its texts."""
    wide = [F.coalesce(F.octet_length(field(f.name)), F.lit(0)) for f in rows.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    n, size = rows.agg(F.count("*"), F.sum(sum(wide, F.lit(0).cast("long")))).first()
    return n <= most_rows and (size or 0) <= most_bytes


def small(rows: DataFrame) -> DataFrame:
    """The table, computed already, as the broadcast side of a join if it fits, else as it is."""
    return F.broadcast(rows) if fits(rows) else rows


_BLANK = {str: re.compile(r"\s"), bytes: re.compile(rb"[\x20\x09-\x0D]")}


def parts(text: str | bytes, size: int) -> Iterator:
    """A text in stretches of ``size`` or more that end before white space, so that no word is cut."""
    at, blank = 0, _BLANK[type(text)]
    while at < len(text):
        found = blank.search(text, at + size)
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop


def fold(buckets: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(buckets)


def unit_hash(*columns: Column) -> Column:
    """A hash of the columns spread evenly over [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int, chars: int) -> DataFrame:
    """A bounded training sample as (doc_id, text, label, weight): at most about ``bound`` documents of
    each class, and ``chars`` characters of all of them.

    Rows are chosen by a hash of their id, so a rerun chooses the same. weight undoes the
    sampling. Labels other than 0 and 1 and null ids are ignored; contradicting labels of a
    document count as 1. Of rows that repeat an id one counts, the one with the smallest text
    hash; a null text is empty.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, bound / max(n, 1)) for k, n in sizes.items()}
    part = F.when(F.col("label") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0)))
    place = unit_hash(F.col("doc_id"), F.lit("sample"))
    sample = rows.where(place < part).select("doc_id", "label", (F.lit(1.0) / part).alias("weight"), place.alias("place"))
    text = F.coalesce("text", F.lit(""))
    found = (
        docs.select("doc_id", text.alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "label", "weight", "place")
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"))
    )
    found = cut(found.select("doc_id", "label", "weight", "place", F.col("row.text").alias("text")))
    # The sample's ids and sizes only: about 2 * bound rows.
    own = sorted((r["place"], r["doc_id"], r["label"], r["n"]) for r in found.select("place", "doc_id", "label", F.length("text").alias("n")).collect())
    if sum(n for *_, n in own) <= chars:
        return found.drop("place")
    chosen, left = {0: [], 1: []}, {0: chars // 2, 1: chars // 2}
    for _, doc_id, kind, n in own:
        if n <= left[kind]:
            chosen[kind].append(doc_id)
            left[kind] -= n
    more = {k: sum(1 for row in own if row[2] == k) / max(len(v), 1) for k, v in chosen.items()}
    stay = docs.sparkSession.createDataFrame([(d, more[k]) for k, v in chosen.items() for d in v], "doc_id long, more double")
    return found.join(F.broadcast(stay), "doc_id").select("doc_id", "text", "label", (F.col("weight") * F.col("more")).alias("weight"))
