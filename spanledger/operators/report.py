"""Reports on ledgers: metrics, snapshot differences, inspection, trust manifests, memory sections (AG3-AG5, I1-I3, J12, T1-T3, C1-C2, U3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from .select import protected

COMPARED = ["kind", "text", "status", "priority", "confidence", "exact", "tags", "supersedes", "conflicts_with", "provenance", "sequence", "roles", "extractors"]


def counts(items: DataFrame) -> DataFrame:
    """AG4: items by kind and status over all histories."""
    return items.groupBy("kind", "status").agg(F.count("*").alias("n_items"), F.count_distinct("history_id").alias("n_histories"))


def metrics(items: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """AG3: one row of counters per history."""
    guard = protected(F.col("kind"), F.col("tags"))
    out = items.groupBy("history_id").agg(
        F.count("*").alias("items"),
        *[F.count_if(F.col("status") == s).alias(s) for s in lx.STATUS_RANK],
        F.count_if(guard).alias("protected"),
        F.count_if("exact").alias("exact"),
        F.sum(F.size("provenance")).alias("spans"),
        *[F.count_if(F.array_contains("tags", t)).alias(t.replace("-", "_")) for t in ("correction-derived", "detected-conflict", "resolves-protected", "ambiguous-supersession", "additive-clarification")],
    )
    if selection is None:
        return out
    return out.join(selection.select("history_id", F.size("selected").alias("selected"), "prompt_tokens", "overflow"), "history_id", "left")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed and modified items of two snapshots with the fields that changed; shared ones too."""
    cols = [c for c in COMPARED if c in before.columns and c in after.columns]
    b = before.select("history_id", "id", F.struct(*cols).alias("b"))
    a = after.select("history_id", "id", F.struct(*cols).alias("a"))
    changed = F.filter(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in cols]), lambda c: c.isNotNull())
    joined = b.join(a, ["history_id", "id"], "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(changed) > 0, "modified").otherwise("shared")
    return joined.select("history_id", "id", change.alias("change"), F.when(change == "modified", changed).otherwise(F.array().cast("array<string>")).alias("fields"))


def diff_selection(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that a history's selection gained and lost."""
    j = before.select("history_id", F.col("selected").alias("b")).join(after.select("history_id", F.col("selected").alias("a")), "history_id", "full_outer")
    none = F.array().cast("array<string>")
    one, two = F.coalesce("b", none), F.coalesce("a", none)
    return j.select("history_id", F.array_sort(F.array_except(two, one)).alias("gained"), F.array_sort(F.array_except(one, two)).alias("lost"))


CONTROL = r"[\x00-\x1F\x7F-\x9F\u2028\u2029\u202A-\u202E\u2066-\u2069]"


def visible(text: Column) -> Column:
    """Control characters written as their code points, so that no two texts look alike."""
    one = lambda c: F.when(c.rlike(CONTROL), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c)
    return F.when(text.rlike(CONTROL), F.array_join(F.transform(F.split(F.replace(text, F.lit("\\"), F.lit("\\\\")), ""), one), "")).otherwise(F.replace(text, F.lit("\\"), F.lit("\\\\")))


def inspect(items: DataFrame, most_items: int = 50, most_links: int = 10, most_chars: int = 200) -> DataFrame:
    """A bounded display: the first items of each history, shortened and with control characters shown."""
    from pyspark.sql import Window

    order = Window.partitionBy("history_id").orderBy("sequence", "kind", "id")
    shown = visible(F.col("text"))
    short = F.when(F.length(shown) > most_chars, F.concat(F.left(shown, F.lit(most_chars)), F.lit("…"))).otherwise(shown)
    rows = items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_items)
    return rows.select("history_id", "place", "id", "kind", "status", short.alias("text"), F.slice("supersedes", 1, most_links).alias("supersedes"), F.slice("conflicts_with", 1, most_links).alias("conflicts_with"), F.size("provenance").alias("n_spans"))


def source_digest(records: DataFrame) -> DataFrame:
    """One digest per history over its records in order."""
    from .archive import record_hash

    rows = records.select("history_id", F.struct("sequence", "source_id", record_hash(records.columns).alias("h")).alias("r"))
    listed = F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat_ws(":", r["sequence"].cast("string"), r["source_id"], r["h"]))
    return rows.groupBy("history_id").agg(F.sha2(F.array_join(listed, ";").cast("binary"), 256).alias("source_digest"), F.count("*").alias("source_count"))


def artifact_digest(items: DataFrame) -> DataFrame:
    """One digest per history over its whole ledger."""
    line = F.struct("sequence", "kind", "id", F.to_json(F.struct(*COMPARED)).alias("json"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: F.concat_ws(":", r["id"], r["json"])), ";")
    return items.groupBy("history_id").agg(F.sha2(joined.cast("binary"), 256).alias("artifact_digest"))


def manifest(records: DataFrame, items: DataFrame, summary: DataFrame, heads: DataFrame) -> DataFrame:
    """A manifest for each history that verifies; its own hash is the anchor to keep elsewhere."""
    out = source_digest(records).join(artifact_digest(items), "history_id").join(heads.select("history_id", F.col("head").alias("archive_head")), "history_id", "left")
    out = out.join(summary.where("passed").select("history_id"), "history_id", "left_semi")
    return out.withColumn("manifest_sha256", tx.hash_of(F.lit("1.0"), *[F.col(c) for c in ("history_id", "source_digest", "source_count", "artifact_digest", "archive_head")]))


#: Fields of a manifest's text, and its limits in bytes and depth.
MANIFEST = ["history_id string", "source_digest string", "source_count bigint", "artifact_digest string", "archive_head string", "manifest_sha256 string"]
MANIFEST_BYTES, MANIFEST_DEPTH = 65_536, 8


def manifest_text(manifests: DataFrame) -> DataFrame:
    """history_id and text: each manifest as JSON, to be kept in a file or table."""
    fields = [f.split(" ")[0] for f in MANIFEST]
    return manifests.select("history_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("text"))


def load_manifests(texts: DataFrame) -> DataFrame:
    """Text, readable and the fields of each manifest text, null where it is none.

    Readable is strict JSON of a bounded size and depth with exactly the known fields; a
    missing archive is a null head.
    """
    text, keys = F.col("text"), sorted(f.split(" ")[0] for f in MANIFEST)
    bounded = (F.octet_length(text) <= MANIFEST_BYTES) & (tx.json_depth(text) <= MANIFEST_DEPTH) & F.try_parse_json(text).isNotNull()
    closed = F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in keys])
    rows = texts.select("text", F.coalesce(bounded & closed, F.lit(False)).alias("shaped"), F.from_json("text", ", ".join(MANIFEST)).alias("m"))
    needed = [f"m.{k}" for k in keys if k != "archive_head"]
    whole = F.lit(True)
    for k in needed:
        whole = whole & F.col(k).isNotNull()
    rows = rows.select("text", (F.col("shaped") & whole).alias("readable"), "m")
    return rows.select("text", "readable", *[F.when(F.col("readable"), F.col(f"m.{k}")).alias(k) for k in (f.split(" ")[0] for f in MANIFEST)])


def verify_manifest(given: DataFrame, anchors: DataFrame, records: DataFrame, items: DataFrame, heads: DataFrame) -> DataFrame:
    """The checks of each manifest as booleans, and passed; the anchor (history_id, expected) is required."""
    own = tx.hash_of(F.lit("1.0"), *[F.col(c) for c in ("history_id", "source_digest", "source_count", "artifact_digest", "archive_head")])
    now = source_digest(records).select("history_id", F.col("source_digest").alias("_s"), F.col("source_count").alias("_n"))
    now = now.join(artifact_digest(items).select("history_id", F.col("artifact_digest").alias("_a")), "history_id", "full_outer")
    now = now.join(heads.select("history_id", F.col("head").alias("_h")), "history_id", "left")
    rows = given.join(anchors.select("history_id", "expected"), "history_id", "left").join(now, "history_id", "left")
    checks = {
        "self_hash": F.col("manifest_sha256") == own,
        "anchor": F.coalesce(F.col("manifest_sha256") == F.col("expected"), F.lit(False)),
        "sources": F.col("source_digest").eqNullSafe(F.col("_s")),
        "count": F.col("source_count").eqNullSafe(F.col("_n")),
        "artifact": F.col("artifact_digest").eqNullSafe(F.col("_a")),
        "archive": F.col("archive_head").isNull() | F.col("archive_head").eqNullSafe(F.col("_h")),
    }
    out = rows.select("history_id", *[c.alias(k) for k, c in checks.items()])
    passed = F.lit(True)
    for k in checks:
        passed = passed & F.col(k)
    return out.withColumn("passed", passed)


def sections(items: DataFrame, selection: DataFrame) -> DataFrame:
    """Each history's active memory by category, and protected items that were left out."""
    names = {
        "goals": "goal", "constraints": "constraint", "corrections": "user_correction", "facts": "confirmed_fact",
        "decisions": "decision", "open_questions": "unresolved", "errors": "exact_error", "references": "exact_reference",
    }
    picked = selection.select("history_id", F.explode("selected").alias("id")).distinct().withColumn("picked", F.lit(True))
    rows = items.join(picked, ["history_id", "id"], "left")
    live = F.col("picked").isNotNull()
    listed = lambda k: F.array_sort(F.collect_list(F.when(live & (F.col("kind") == k), F.struct("sequence", "id", "text"))))
    left_out = protected(F.col("kind"), F.col("tags")) & ~live & ~F.col("status").isin("superseded", "discarded")
    return rows.groupBy("history_id").agg(*[listed(k).alias(n) for n, k in names.items()], F.array_sort(F.collect_list(F.when(left_out, F.col("id")))).alias("omitted_protected"))


def certificate(candidates: DataFrame, kept: DataFrame, summary: DataFrame) -> DataFrame:
    """Issued iff a history verifies and every detected protected claim (history_id, id) is among those kept.

    lost counts the claims that are not; a kept row that is repeated or stands for no claim changes nothing.
    """
    found = candidates.select("history_id", "id").distinct()
    held = kept.select("history_id", "id", F.lit(1).alias("held")).distinct()
    told = found.join(held, ["history_id", "id"], "left").groupBy("history_id").agg(F.count("*").alias("detected"), F.count("held").alias("retained"))
    zero = F.lit(0).cast("bigint")
    out = summary.join(told, "history_id", "left").select("history_id", "passed", F.coalesce("detected", zero).alias("detected"), F.coalesce("retained", zero).alias("retained"))
    out = out.withColumn("lost", F.col("detected") - F.col("retained"))
    return out.withColumn("issued", F.col("passed") & (F.col("lost") == 0))


#: Schema versions and whether they can be read.
SCHEMA_VERSIONS = {"1.0": True}


def schema_support(artifacts: DataFrame) -> DataFrame:
    """Artifacts (schema_version, ...) with supported; unknown and null versions are not."""
    known = F.create_map(*[F.lit(x) for k, v in SCHEMA_VERSIONS.items() for x in (k, v)])
    return artifacts.withColumn("supported", F.coalesce(F.try_element_at(known, F.col("schema_version")), F.lit(False)))
