"""Secret masking: fixed detectors, overlap resolution, length-preserving masks, reports."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.tables import unnest

SPOT = "array<struct<start:int,end:int,detector:string>>"
FINDING = "array<struct<start:int,end:int,detector:string,masked:int,line_ends:int>>"


def _spot(start: Column, length: Column, name: str) -> Column:
    return F.struct(start.cast("int").alias("start"), (start + length).cast("int").alias("end"), F.lit(name).alias("detector"))


def pem_spots(content: Column) -> Column:
    """Each label's earliest open BEGIN up to the next END of that label."""
    marks = F.transform(
        tx.matches(content, lx.PEM),
        lambda m: F.struct(
            m["start"].alias("start"), F.length(m["text"]).alias("size"), F.regexp_extract(m["text"], lx.PEM, 1).alias("side"), F.regexp_extract(m["text"], lx.PEM, 2).alias("label")
        ),
    )
    first = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))

    def step(open_: Column, m: Column, _: Column) -> tuple[Column, Column]:
        known = F.map_contains_key(open_, m["label"])
        begins = m["side"] == "BEGIN"
        one = F.map_from_arrays(F.array(m["label"]), F.array(m["start"]))
        after = F.when(begins & ~known, F.map_concat(open_, one)).when(begins, open_).otherwise(F.map_filter(open_, lambda k, v: k != m["label"]))
        closed = F.array(F.try_element_at(open_, m["label"]), m["start"] + m["size"])
        return after, F.when(~begins & known, closed).otherwise(F.array().cast("array<int>"))

    def told(edges: Column) -> Column:  # starts and ends in turn
        place = F.sequence(F.lit(0), F.size(edges) - 1, F.lit(2))
        found = F.transform(place, lambda k: _spot(F.get(edges, k), F.get(edges, k + 1) - F.get(edges, k), "pem_private_key"))
        return F.when(F.size(edges) > 0, found).otherwise(F.array().cast(SPOT))

    return tx.bound(tx.bound(marks, lambda all_: tx.folded(all_, first, step)), told)


def _secret_of(name: str, match: Column) -> Column:
    """The part of a detector's match that is secret."""
    if name in ("bearer_token", "basic_authorization"):
        secret = F.regexp_extract(match["text"], lx.SECRETS[name], 2)
        return _spot(match["start"] + F.length(match["text"]) - F.length(secret), F.length(secret), name)
    if name == "credential_assignment":
        value = F.regexp_extract(match["text"], f"{lx.SECRETS[name]}({lx.ASSIGNED})", 1)
        quoted = value.rlike("\\A[\"'].*[\"']\\z") & (F.left(value, F.lit(1)) == F.right(value, F.lit(1)))
        at = match["start"] + F.length(match["text"]) - F.length(value)
        return _spot(at + F.when(quoted, 1).otherwise(0), F.length(value) - F.when(quoted, 2).otherwise(0), name)
    return _spot(match["start"], F.length(match["text"]), name)


def spots(content: Column, detectors: list[str] = lx.DETECTORS) -> Column:
    """What to mask, from left to right without overlap; of overlapping ones the earliest, longest, first detector."""
    found = [F.array().cast(SPOT)]
    for name in detectors:
        if name == "pem_private_key":
            found.append(pem_spots(content))
        else:
            pattern = f"{lx.SECRETS[name]}(?:{lx.ASSIGNED})" if name == "credential_assignment" else lx.SECRETS[name]
            found.append(F.transform(tx.matches(content, pattern), partial(_secret_of, name)))
    rank = F.create_map(*[F.lit(x) for n, d in enumerate(lx.DETECTORS) for x in (d, n)])
    ordered = F.array_sort(
        F.transform(F.concat(*found), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("reach"), F.element_at(rank, s["detector"]).alias("rank"), s.alias("spot")))
    )

    def step(end: Column, o: Column, k: Column) -> tuple[Column, Column]:
        free = end <= o["start"]
        return F.when(free, -o["reach"]).otherwise(end), F.when(free, F.array(k)).otherwise(F.array().cast("array<int>"))

    return tx.bound(ordered, lambda all_: F.transform(tx.folded(all_, F.lit(0), step), lambda k: F.get(all_, k)["spot"]))


def _cut_out(content: Column, found: Column) -> Column:
    """array<struct<before, secret>>: the text between each spot and the one before it, and the spot's own.

    Texts are cut in two steps, so that each character is passed over a few times and not once for every spot.
    """

    def block(all_: Column, k: Column) -> Column:
        own = F.slice(all_, k * tx.BLOCK + 1, tx.BLOCK)
        begin = F.when(k == 0, 0).otherwise(F.try_element_at(all_, k * tx.BLOCK)["end"])
        end = F.element_at(all_, F.least((k + 1) * tx.BLOCK, F.size(all_)))["end"]
        shape = F.struct(own.alias("own"), begin.alias("begin"), F.substring(content, begin + 1, end - begin).alias("text"))

        def cut(b: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                last = F.when(i == 0, b["begin"]).otherwise(F.try_element_at(b["own"], i)["end"])
                piece = lambda a, z: F.substring(b["text"], a - b["begin"] + 1, z - a)
                return F.struct(piece(last, s["start"]).alias("before"), piece(s["start"], s["end"]).alias("secret"))

            return F.transform(b["own"], one)

        return tx.bound(shape, cut)

    def whole(all_: Column) -> Column:
        last = ((F.size(all_) - 1) / tx.BLOCK).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda k: block(all_, k)))

    return F.when(F.size(found) > 0, tx.bound(found, whole)).otherwise(F.array().cast("array<struct<before:string,secret:string>>"))


def redact(records: DataFrame, mask: str = "*", detectors: list[str] = lx.DETECTORS, limit: int = 10_000) -> DataFrame:
    """Records with masked content and an array column findings; line ends and length stay.

    A record with over ``limit`` findings fails the job. Null content stays null.
    """
    if mask not in lx.MASKS:
        raise ValueError(f"mask must be one of {lx.MASKS}")
    content, spotted, parts = F.col("content"), tx.fresh(records, "spotted"), tx.fresh(records, "parts")
    rows = records.withColumn(spotted, F.coalesce(spots(content, detectors), F.array().cast(SPOT)))
    rows = rows.withColumn(spotted, F.when(F.size(spotted) <= limit, F.col(spotted)).otherwise(F.raise_error(F.lit("too many findings in a record")).cast(SPOT)))
    rows = rows.withColumn(parts, _cut_out(content, F.col(spotted)))
    kept = f"[{lx.LINE_ENDS}]"
    shown = F.flatten(F.transform(parts, lambda p: F.array(p["before"], F.regexp_replace(p["secret"], f"[^{lx.LINE_ENDS}]", mask))))
    tail = F.substring(content, F.try_element_at(F.col(spotted), F.lit(-1))["end"] + 1, F.length(content))

    def told(all_: Column, s: Column, i: Column) -> Column:
        secret = F.get(all_, i)["secret"]
        hidden = F.length(F.regexp_replace(secret, kept, ""))
        return F.struct(s["start"], s["end"], s["detector"], hidden.alias("masked"), (F.length(secret) - hidden).alias("line_ends"))

    found = tx.bound(F.col(parts), lambda all_: F.transform(spotted, lambda s, i: told(all_, s, i)))
    return rows.withColumn("findings", found.cast(FINDING)).withColumn(
        "content", F.when(F.size(spotted) == 0, content).otherwise(F.concat(F.array_join(shown, ""), tail))
    ).drop(spotted, parts)


def findings(redacted: DataFrame) -> DataFrame:
    """One row per masked secret with its count of masked characters and kept line ends."""
    keep = ["history_id", "source_id", "sequence"]
    return unnest(redacted, keep, F.col("findings"), "f").select(*keep, "f.*")


def report(found: DataFrame) -> DataFrame:
    """AG6: detector, findings, sources changed and masked characters."""
    return found.groupBy("detector").agg(
        F.count("*").alias("n_findings"), F.count_distinct("history_id", "source_id").alias("n_sources"), F.sum("masked").cast("bigint").alias("n_masked")
    )


def verify_redaction(original: DataFrame, redacted: DataFrame, mask: str = "*", detectors: list[str] = lx.DETECTORS) -> DataFrame:
    """Replay: records whose masked content is not what masking the original gives, either way."""
    again = redact(original, mask, detectors).select("history_id", "source_id", "content")
    given = redacted.select("history_id", "source_id", "content")
    return again.exceptAll(given).withColumn("side", F.lit("expected")).unionByName(given.exceptAll(again).withColumn("side", F.lit("given")))
