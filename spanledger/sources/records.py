"""Reading records: JSON lines or documents, strict decoding, defaults, limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

#: Roles whose words are data unless a host says otherwise.
DATA_ROLES = ["assistant", "tool", "function"]


@dataclass(frozen=True)
class Limits:
    """Per history, never truncated: what exceeds them fails."""

    max_records: int = 100_000
    max_line_chars: int = 1_048_576
    max_record_bytes: int = 4_194_304
    max_total_bytes: int = 67_108_864
    max_depth: int = 128
    max_digits: int = 640


def read_json(spark: SparkSession, path: str, lines: bool | None = True, limits: Limits = Limits()) -> DataFrame:
    """Records from JSON lines, or from documents: an array, an object with sources, events or messages, or one object.

    Each file is a history unless its records name history_id. Texts that are no strict JSON
    (duplicate keys, NaN, nested or with integers beyond the limits) fail the job. Where lines
    is None, files whose name ends in .jsonl hold lines, and of the others those that are no
    JSON document as a whole; then every file is read as one text, within the bytes of a history.
    """
    if lines is None:
        parsed = _detected(spark, path, limits)
        return defaults(parsed, limits)
    raw = spark.read.option("wholetext", str(not lines).lower()).text(path)
    raw = raw.select(F.regexp_replace("value", "\\A\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    if lines:
        raw = raw.where(F.trim("value") != "")
        raw = raw.withColumn("value", _guard(F.length("value") <= limits.max_line_chars, "line too long", F.col("value")))
    parsed = raw.withColumn("v", _strict(F.col("value"), limits))
    if not lines:
        parsed = parsed.select("file", "row", F.posexplode(_members(F.col("v"))).alias("pos", "v"))
    else:
        parsed = parsed.withColumn("pos", F.lit(0))
    return defaults(parsed, limits)


def _strict(text: Column, limits: Limits) -> Column:
    """The text as a variant, or a failed job."""
    value = tx.strict_json(text)
    deep = tx.json_depth(text) > limits.max_depth
    said = F.when(deep, "nested too deep").when(tx.has_long_integer(text, limits.max_digits), "integer too long").when(value.isNull(), "not strict JSON")
    return F.when(said.isNull(), value).otherwise(F.raise_error(said).cast("void"))


def _members(v: Column) -> Column:
    """The records of a document: of an array, of a list under a known name, or itself."""
    inner = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("sources", "events", "messages")]
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *inner, F.array(v))


def _detected(spark: SparkSession, path: str, limits: Limits) -> DataFrame:
    """Files read whole, each taken as lines or as a document by its name or by what it holds."""
    raw = spark.read.option("wholetext", "true").text(path)
    raw = raw.select(F.regexp_replace("value", "\\A\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    raw = raw.withColumn("value", _guard(F.octet_length("value") <= limits.max_total_bytes, "file too large", F.col("value")))
    by_line = F.endswith("file", F.lit(".jsonl")) | tx.strict_json(F.col("value")).isNull()
    texts = F.when(by_line, F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).otherwise(F.array("value"))
    rows = raw.select("file", "row", by_line.alias("by_line"), F.posexplode(texts).alias("line", "value"))
    rows = rows.withColumn("value", _guard(~F.col("by_line") | (F.length("value") <= limits.max_line_chars), "line too long", F.col("value")))
    rows = rows.withColumn("v", _strict(F.col("value"), limits))
    many = F.when(F.col("by_line"), F.array("v")).otherwise(_members(F.col("v")))
    return rows.select("file", "row", "line", F.posexplode(many).alias("at", "v")).select("file", "row", (F.col("line") + F.col("at")).alias("pos"), "v")


def _guard(ok: Column, message: str, value: Column) -> Column:
    """The value, or a failed job."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("void"))


def defaults(parsed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Typed records from variants v in the order (file, row, pos).

    A missing sequence is the place in the history; a missing id is made of sequence and hash.
    Words of data roles are untrusted unless the host says trusted_for_state.
    """
    from pyspark.sql import Window

    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    rows = parsed.select(
        F.coalesce(get("$.history_id"), F.col("file")).alias("history_id"),
        "row",
        "pos",
        get("$.content_sha256").alias("given"),
        get("$.id").alias("id"),
        get("$.sequence", "bigint").alias("seq"),
        get("$.role").alias("role"),
        get("$.content").alias("content"),
        get("$.timestamp").alias("timestamp"),
        F.coalesce(F.to_json(get("$.metadata", "variant")), F.lit("{}")).alias("metadata"),
        F.coalesce(get("$.authority.trusted_for_state", "boolean"), get("$.metadata.trusted_for_state", "boolean"), F.lit(False)).alias("trusted"),
        F.coalesce(get("$.authority.trusted_for_state", "boolean"), get("$.metadata.trusted_for_state", "boolean")).alias("said"),
    )
    other = (F.col("given") != "") & (F.col("given") != F.sha2(F.col("content").cast("binary"), 256))
    wrong = F.raise_error(F.concat_ws(": ", "history_id", F.lit("content_sha256 of another content"))).cast("string")
    rows = rows.withColumn("content", F.when(F.coalesce(other, F.lit(False)), wrong).otherwise(F.col("content")))
    order = Window.partitionBy("history_id").orderBy("row", "pos")
    rows = rows.withColumn("sequence", F.coalesce("seq", (F.row_number().over(order) - 1).cast("bigint")))
    made = F.concat(F.lit("s"), F.lpad(F.col("sequence").cast("string"), 6, "0"), F.lit("-"), F.left(tx.hash_of(F.col("role"), F.col("content")), F.lit(20)))
    out = rows.select(
        "history_id", F.coalesce("id", made).alias("source_id"), "sequence", "role", "content", "timestamp", "metadata", "trusted",
        (F.lower("role").isin(DATA_ROLES) & F.coalesce(~F.col("said"), F.lit(False))).alias("untrusted"),
    )
    return check(out, limits)


def check(records: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Fails on a missing role or content, a repeated id or sequence, or a limit; else the records."""
    from pyspark.sql import Window

    own = Window.partitionBy("history_id")
    size = F.octet_length("content") + F.octet_length(F.coalesce("metadata", F.lit("")))
    bad = (
        F.when(F.col("role").isNull() | (F.trim("role") == "") | F.col("content").isNull(), "role and content are required")
        .when(F.col("sequence") < 0, "negative sequence")
        .when(size > limits.max_record_bytes, "record too large")
        .when(F.count("*").over(own) > limits.max_records, "too many records")
        .when(F.sum(size).over(own) > limits.max_total_bytes, "history too large")
        .when(F.count("*").over(Window.partitionBy("history_id", "source_id")) > 1, "repeated id")
        .when(F.count("*").over(Window.partitionBy("history_id", "sequence")) > 1, "repeated sequence")
    )
    checked = records.withColumn("_bad", bad)
    checked = checked.withColumn("_ok", F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat_ws(": ", "history_id", "_bad")).cast("boolean")).otherwise(F.lit(True)))
    return checked.where("_ok").drop("_bad", "_ok")


def write_json(records: DataFrame, path: str) -> None:
    """K3: records as JSON lines."""
    records.write.json(path)


ROLES = sorted({*lx.STATE_ROLES, *DATA_ROLES})
