"""Artifacts: a ledger with its selection, verdict and digests as one JSON text per history, written, read strictly and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import SCHEMA_VERSIONS, source_digest
from .resolve import COLUMNS

ITEM = (
    "struct<sequence:bigint,kind:string,id:string,text:string,status:string,priority:int,confidence:double,exact:boolean,tags:array<string>,supersedes:array<string>,"
    "conflicts_with:array<string>,provenance:array<struct<source_id:string,start:int,end:int,quote:string>>,roles:array<string>,extractors:array<string>>"
)
FIELDS = [
    "schema_version string", "ledger_complete boolean", "source_digest string", "source_count bigint", f"items array<{ITEM}>", "selected_item_ids array<string>",
    "passed boolean", "artifact_sha256 string",
]
KEYS = sorted(f.split(" ")[0] for f in FIELDS)
SEAL = r',"artifact_sha256":"[0-9a-f]{64}"\}\z'


def _digest(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def build(items: DataFrame, selection: DataFrame, summary: DataFrame, records: DataFrame, active_only: bool = False) -> DataFrame:
    """K1: history_id and artifact. active_only keeps selected items only (P10) and says that the ledger is not whole.

    The digest covers all of the text before it. A history without items has an empty list.
    """
    picked = selection.select("history_id", "selected")
    rows = items
    if active_only:
        rows = items.join(picked.select("history_id", F.explode("selected").alias("id")).distinct(), ["history_id", "id"], "left_semi")
    order = ["sequence", "kind", "id"]
    listed = rows.groupBy("history_id").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in COLUMNS if c not in ("history_id", *order)]))).alias("items"))
    whole = source_digest(records).join(listed, "history_id", "left").join(picked, "history_id", "left").join(summary.select("history_id", "passed"), "history_id", "left")
    none = F.array().cast("array<string>")
    body = F.to_json(
        F.struct(
            F.lit(next(iter(SCHEMA_VERSIONS))).alias("schema_version"), F.lit(not active_only).alias("ledger_complete"), "source_digest", "source_count",
            F.coalesce(F.col("items").cast(f"array<{ITEM}>"), F.array().cast(f"array<{ITEM}>")).alias("items"), F.coalesce("selected", none).alias("selected_item_ids"), F.coalesce("passed", F.lit(False)).alias("passed"),
        )
    )
    sealed = F.concat(F.expr("left(body, length(body) - 1)"), F.lit(',"artifact_sha256":"'), _digest(F.col("body")), F.lit('"}'))
    return whole.select("history_id", body.alias("body")).select("history_id", sealed.alias("artifact"))


def load(artifacts: DataFrame, max_bytes: int = 67_108_864) -> DataFrame:
    """history_id, artifact, readable and the fields as a struct a, null where the text is no artifact.

    Readable is strict JSON without repeated keys, with exactly the known fields, of a bounded size.
    """
    text = F.col("artifact")
    strict = F.try_parse_json(text).isNotNull() & (F.octet_length(text) <= max_bytes)
    closed = F.coalesce(F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in KEYS]), F.lit(False))
    parsed = F.from_json(text, ", ".join(FIELDS))
    rows = artifacts.select("history_id", "artifact", F.coalesce(strict, F.lit(False)).alias("strict"), closed.alias("closed"), parsed.alias("a"))
    readable = F.col("strict") & F.col("closed") & F.col("a.items").isNotNull() & F.col("a.selected_item_ids").isNotNull()
    return rows.select("history_id", "artifact", readable.alias("readable"), F.when(readable, F.col("a")).alias("a"))


def issues(loaded: DataFrame, records: DataFrame) -> DataFrame:
    """history_id and code: what an artifact's envelope shows by itself and against its records."""
    now = source_digest(records).select("history_id", F.col("source_digest").alias("s"), F.col("source_count").alias("n"))
    rows = loaded.join(now, "history_id", "left")
    ids, picked = F.transform("a.items", lambda i: i["id"]), F.col("a.selected_item_ids")
    body = F.concat(F.regexp_replace("artifact", SEAL, ""), F.lit("}"))
    rules = {
        "unsupported_schema_version": ~F.coalesce(F.col("a.schema_version").isin([k for k, v in SCHEMA_VERSIONS.items() if v]), F.lit(False)),
        "artifact_digest_mismatch": ~_digest(body).eqNullSafe(F.col("a.artifact_sha256")),
        "incomplete_ledger": ~F.coalesce(F.col("a.ledger_complete"), F.lit(False)),
        "source_digest_mismatch": ~F.col("a.source_digest").eqNullSafe(F.col("s")),
        "source_count_mismatch": ~F.col("a.source_count").eqNullSafe(F.col("n")),
        "duplicate_item_id": F.size(F.array_distinct(ids)) < F.size(ids),
        "duplicate_selected_item_id": F.size(F.array_distinct(picked)) < F.size(picked),
        "selected_item_missing": F.size(F.array_except(picked, ids)) > 0,
    }
    told = F.filter(F.array(*[F.when(c, F.lit(code)) for code, c in rules.items()]), lambda c: c.isNotNull())
    codes = F.when(F.col("readable"), told).otherwise(F.array(F.lit("invalid_artifact_json")))
    return rows.select("history_id", F.explode(codes).alias("code"))


def items_of(loaded: DataFrame) -> DataFrame:
    """The items of readable artifacts, as they were before; for verification anew."""
    return loaded.where("readable").select("history_id", F.explode("a.items").alias("i")).select("history_id", "i.*").select(*COLUMNS)
