"""Requests as a stream of JSON lines, each answered by exactly one response (S11, ST5).

A request names an operation and a payload; what is wrong with it is found by column functions
and becomes the code of its response. Sessions are keyed state (see ``sessions``): a request
that brings events is taken as a whole or refused as a whole, in the order of arrival. The
other operations are joins over the batch: each compiles, or checks against, the records its
session had when the request came.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..operators.report import source_digest
from ..plans.compile import compile_histories
from . import sessions

SCHEMA = "spanledger.request.v1"
#: operation -> fields its payload must have, and those it may have.
OPERATIONS = {
    "capabilities": ([], ()),
    "ingest_source_events": (["events", "session_id"], ()),
    "compile_memory": (["session_id"], ()),
    "render_context": (["bundle"], ()),
    "verify_memory": (["bundle", "session_id"], ()),
    "inspect_memory": (["bundle"], ()),
}
NEED_SESSION = ["ingest_source_events", "compile_memory", "verify_memory"]
#: Codes and their categories.
CATEGORIES = {
    "resource_limit_exceeded": "resource_limit", "unknown_session": "state", "operation_timed_out": "timeout",
    "invalid_json": "invalid_request", "invalid_type": "invalid_request", "invalid_value": "invalid_request",
    "unsupported_operation": "invalid_request", "unsupported_schema": "invalid_request",
    "integrity_check_failed": "integrity", "connector_failure": "runtime",
}
BUNDLE = ["session_id", "source_count", "source_digest", "rendered", "rendered_sha256"]
RECORD = "history_id string, source_id string, sequence bigint, role string, content string, no bigint"
ANSWER = "no bigint, request_id string, operation string, ok boolean, category string, code string, result string"


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 8 * 1024 * 1024
    max_depth: int = 128
    max_digits: int = 640
    max_id: int = 256


def lone_surrogate(raw: Column) -> Column:
    """Whether a JSON text has an escaped half of a surrogate pair without its other half."""
    plain = F.regexp_replace(raw, r"\\\\", "")
    paired = F.regexp_replace(plain, r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", "")
    return tx.like(paired, r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}")


def _kind(v: Column, path: str) -> Column:
    """What stands at a path: STRING, BIGINT, OBJECT, ARRAY and so on; null if nothing does."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), r"\A\w+", 0)


def _fields(v: Column, path: str, required: list[str], optional: tuple[str, ...] = ()) -> Column:
    """Whether an object has other fields than it may or lacks one it must have."""
    return F.size(tx.key_faults(F.try_variant_get(v, path, "map<string,variant>"), required, optional)) > 0


def decode(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(no, raw) as no, request_id, operation, session_id, payload, bundle, events and code, null where nothing is wrong.

    Of several faults the first in the order of the envelope is told. request_id and operation
    are there as far as the envelope could be read.
    """
    raw = F.coalesce("raw", F.lit(""))
    rows = requests.select("no", raw.alias("raw")).where(F.trim("raw") != "")
    raw = F.col("raw")
    early = (
        F.when(F.octet_length(raw) > limits.max_bytes, "resource_limit_exceeded")
        .when(tx.json_depth(raw) > limits.max_depth, "resource_limit_exceeded")
        .when(tx.has_long_integer(raw, limits.max_digits), "invalid_value")
    )
    rows = rows.withColumn("early", early)
    rows = rows.withColumn("v", F.when(F.col("early").isNull(), tx.strict_json(raw)))
    v = F.col("v")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    rows = rows.withColumn("early", F.coalesce("early", F.when(v.isNull(), "invalid_json").when(lone_surrogate(raw), "invalid_value").when(_kind(v, "$") != "OBJECT", "invalid_type")))
    readable = F.col("early").isNull()
    rows = rows.withColumn("v", F.when(readable, v))
    id_, op = F.when(_kind(v, "$.request_id") == "STRING", get("$.request_id")), F.when(_kind(v, "$.operation") == "STRING", get("$.operation"))
    rows = rows.withColumns({"own_id": id_, "own_op": op})
    given = F.col("own_op")
    fields = [F.when((given == name) & _fields(v, "$.payload", *own), "invalid_value") for name, own in OPERATIONS.items()]
    wrong_type = lambda path, kind: F.coalesce(_kind(v, path), F.lit("VOID")) != kind
    has_bundle, has_session = given.isin([n for n, (r, _) in OPERATIONS.items() if "bundle" in r]), given.isin(NEED_SESSION)
    steps = [
        F.col("early"),
        F.when(_fields(v, "$", ["schema", "request_id", "operation", "payload"]), "invalid_value"),
        F.when(~get("$.schema").eqNullSafe(F.lit(SCHEMA)), "unsupported_schema"),
        F.when(F.coalesce(F.col("own_id"), F.lit("")) == "", "invalid_type"),
        F.when(F.length("own_id") > limits.max_id, "invalid_value"),
        F.when(F.coalesce(given, F.lit("")) == "", "invalid_type"),
        F.when(wrong_type("$.payload", "OBJECT"), "invalid_type"),
        F.when(~given.isin(list(OPERATIONS)), "unsupported_operation"),
        *fields,
        F.when(has_session & wrong_type("$.payload.session_id", "STRING"), "invalid_type"),
        F.when((given == "ingest_source_events") & wrong_type("$.payload.events", "ARRAY"), "invalid_type"),
        F.when((given == "ingest_source_events") & F.exists(F.coalesce(get("$.payload.events", "array<variant>"), F.array()), _bad_event), "invalid_value"),
        F.when(has_bundle & wrong_type("$.payload.bundle", "OBJECT"), "invalid_type"),
        F.when(has_bundle & _fields(v, "$.payload.bundle", BUNDLE), "invalid_value"),
    ]
    events = F.transform(F.coalesce(get("$.payload.events", "array<variant>"), F.array()), _event)
    bundle = F.struct(*[get(f"$.payload.bundle.{c}", "bigint" if c == "source_count" else "string").alias(c) for c in BUNDLE])
    # An envelope that is not whole is answered without id and operation; so is one whose id comes to nothing.
    known = F.coalesce(steps[1], steps[2], steps[3]).isNull() & readable
    return rows.select(
        "no",
        F.when(known, F.col("own_id")).alias("request_id"),
        F.when(known & F.coalesce(*steps[4:6]).isNull(), given).alias("operation"),
        get("$.payload.session_id").alias("session_id"),
        bundle.alias("bundle"),
        events.cast("array<struct<source_id:string,sequence:bigint,role:string,content:string,digest:string>>").alias("events"),
        F.coalesce(*steps).alias("code"),
    )


def _bad_event(e: Column) -> Column:
    get = lambda path, kind="string": F.try_variant_get(e, path, kind)
    low = F.coalesce(get("$.sequence", "bigint") < 0, F.lit(False))
    return get("$.id").isNull() | get("$.role").isNull() | get("$.content").isNull() | low


def _event(e: Column) -> Column:
    get = lambda path, kind="string": F.try_variant_get(e, path, kind)
    role, content = get("$.role"), get("$.content")
    return F.struct(get("$.id").alias("source_id"), get("$.sequence", "bigint").alias("sequence"), role.alias("role"), content.alias("content"), tx.hash_of(role, content).alias("digest"))


def _named(struct: Row | dict) -> dict:
    """A nested struct by name; Spark hands it over as either."""
    return struct if isinstance(struct, dict) else struct.asDict()


class RequestSession(sessions.Session):
    """Requests of one session in the order of arrival: takes events, says whether the session is known."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: r["no"]):
            out, taken = row.asDict(), []
            if row["code"] is None and row["operation"] in NEED_SESSION:
                if row["operation"] == "ingest_source_events":
                    code, taken = self.take(list(row["events"] or []))
                    out["code"] = code and ("resource_limit_exceeded" if code == sessions.TOO_MANY else "invalid_value")
                elif not self.held.exists():
                    out["code"] = "unknown_session"
            out["n_sources"] = self.size()[0] if row["operation"] in NEED_SESSION else None
            out["events"] = [Row(**{**_named(e), "sequence": place}) for e, place in taken]
            yield Row(**out)


Handler = Callable[[DataFrame, DataFrame], DataFrame]


def _records_at(requests: DataFrame, records: DataFrame) -> DataFrame:
    """The records each request's session had when it came, as a history named by the request's number."""
    own = requests.select(F.col("session_id").alias("history_id"), F.col("no").alias("_no"))
    rows = records.join(own, "history_id").where(F.col("no") <= F.col("_no"))
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("_no").cast("string").alias("history_id"), "source_id", "sequence", "role", "content",
        none.alias("timestamp"), F.lit("{}").alias("metadata"), F.lit(False).alias("trusted"), F.lit(False).alias("untrusted"),
    )


def compile_memory(requests: DataFrame, records: DataFrame) -> DataFrame:
    """A bundle: the rendered memory with its digest, bound to the session's records."""
    rows = _records_at(requests, records)
    done = compile_histories(rows)
    told = done.prompts().select("history_id", "prompt").join(source_digest(rows), "history_id")
    told = told.join(requests.select(F.col("no").cast("string").alias("history_id"), "no", "session_id"), "history_id")
    bundle = F.struct("session_id", "source_count", "source_digest", F.col("prompt").alias("rendered"), F.sha2(F.col("prompt").cast("binary"), 256).alias("rendered_sha256"))
    return told.select("no", F.to_json(F.struct(bundle.alias("bundle"))).alias("result"), F.lit(None).cast("string").alias("code"))


def _sealed() -> Column:
    """Whether a bundle's own digest holds."""
    return F.col("bundle.rendered_sha256").eqNullSafe(F.sha2(F.col("bundle.rendered").cast("binary"), 256))


def render_context(requests: DataFrame, records: DataFrame) -> DataFrame:
    told = F.struct(F.col("bundle.rendered").alias("context"), F.col("bundle.rendered_sha256").alias("rendered_sha256"))
    return requests.select("no", F.to_json(told).alias("result"), F.when(~_sealed(), "integrity_check_failed").alias("code"))


def verify_memory(requests: DataFrame, records: DataFrame) -> DataFrame:
    """What a bundle is bound to against the session's records now."""
    now = source_digest(_records_at(requests, records)).select(F.col("history_id").cast("bigint").alias("no"), F.col("source_digest").alias("d"), F.col("source_count").alias("c"))
    rows = requests.join(now, "no", "left")
    rules = {
        "rendered_digest_mismatch": ~_sealed(),
        "session_mismatch": ~F.col("bundle.session_id").eqNullSafe(F.col("session_id")),
        "source_count_mismatch": ~F.col("bundle.source_count").eqNullSafe(F.col("c")),
        "source_digest_mismatch": ~F.col("bundle.source_digest").eqNullSafe(F.col("d")),
    }
    issues = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    told = F.struct((F.size(issues) == 0).alias("passed"), issues.alias("issues"))
    return rows.select("no", F.to_json(told).alias("result"), F.lit(None).cast("string").alias("code"))


def inspect_memory(requests: DataFrame, records: DataFrame) -> DataFrame:
    text = F.col("bundle.rendered")
    told = F.struct("bundle.session_id", "bundle.source_count", F.size(tx.line_array(text)).alias("lines"), F.length(text).alias("characters"), _sealed().alias("sealed"))
    return requests.select("no", F.to_json(told).alias("result"), F.lit(None).cast("string").alias("code"))


HANDLERS: dict[str, Handler] = {"compile_memory": compile_memory, "render_context": render_context, "verify_memory": verify_memory, "inspect_memory": inspect_memory}


def serve(stream: DataFrame, table: str, checkpoint: str, handlers: dict[str, Handler] = HANDLERS, limits: Limits = Limits(), most: int = sessions.MOST) -> None:
    """Answers a stream of (no, raw): below ``table`` the records of sessions and, by batch, the responses.

    no orders requests by arrival and is unique. A handler gets the requests of its operation
    that nothing was wrong with and all records of their sessions, and gives (no, result, code).
    """
    spark = stream.sparkSession
    asked = decode(stream, limits)
    # Requests that no session is asked about are spread; their keys never hold state.
    lone = F.concat(F.lit("\u0000"), (F.col("no") % sessions.BUCKETS).cast("string"))
    asked = asked.withColumn("key", F.when(F.col("code").isNull() & F.col("operation").isin(NEED_SESSION), F.col("session_id")).otherwise(lone))
    schema = StructType([*asked.schema.fields, *StructType.fromDDL("n_sources bigint").fields])
    told = asked.groupBy("key").transformWithState(RequestSession(most), schema, "append", "none")

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            events = batch.select("no", F.col("session_id").alias("history_id"), F.explode("events").alias("e"))
            rows = events.select("history_id", "e.source_id", "e.sequence", "e.role", "e.content", "no")
            sessions._replace(rows.withColumn("bucket", sessions.bucket(F.col("history_id"))), f"{table}/records", number)
            fine = batch.where("code is null")
            own = fine.where(F.col("operation").isin(NEED_SESSION)).select(sessions.bucket(F.col("session_id")).alias("b")).distinct().collect()
            records = sessions.stored(spark, table, StructType.fromDDL(RECORD), number, [r["b"] for r in own])  # BUCKETS at most
            about = F.struct(F.array(*[F.lit(o) for o in OPERATIONS]).alias("operations"), F.lit(SCHEMA).alias("schema"), F.lit(True).alias("incremental"))
            counted = F.struct("session_id", F.size("events").alias("accepted_events"), F.col("n_sources").alias("source_count"))
            result = F.when(F.col("operation") == "capabilities", F.to_json(about)).when(F.col("operation") == "ingest_source_events", F.to_json(counted))
            answers = fine.where(F.col("operation").isin("capabilities", "ingest_source_events")).select("no", result.alias("result"), F.lit(None).cast("string").alias("code"))
            there = {r["operation"] for r in fine.select("operation").distinct().collect()}  # OPERATIONS at most
            for name in sorted(there & set(handlers)):
                answers = answers.unionByName(handlers[name](fine.where(F.col("operation") == name), records))
            respond(batch, answers).write.mode("overwrite").parquet(f"{table}/responses/batch={number}")
        finally:
            batch.unpersist()

    before = spark.conf.get(sessions.PROVIDER, None)
    spark.conf.set(sessions.PROVIDER, sessions.ROCKSDB)
    try:
        told.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(sessions.PROVIDER) if before is None else spark.conf.set(sessions.PROVIDER, before)


def respond(batch: DataFrame, answers: DataFrame) -> DataFrame:
    """Exactly one response for each request; an operation that gave none has failed."""
    told = answers.select("no", "result", F.col("code").alias("late"), F.lit(True).alias("answered"))
    rows = batch.select("no", "request_id", "operation", "code").join(told, "no", "left")
    code = F.coalesce("code", "late", F.when(F.col("answered").isNull(), "connector_failure"))
    categories = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    rows = rows.withColumn("code", code)
    return rows.select(
        "no", "request_id", "operation", F.col("code").isNull().alias("ok"), F.try_element_at(categories, F.col("code")).alias("category"), "code",
        F.when(F.col("code").isNull(), F.col("result")).alias("result"),
    )


def responses(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(ANSWER).parquet(f"{table}/responses/*")
