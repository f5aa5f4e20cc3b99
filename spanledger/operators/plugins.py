"""Claims from elsewhere: model responses and other extractors, checked before they count (G15, G17, UD1, UD2, UD5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from .extract import can_author
from .resolve import COLUMNS
from .verify import atomic_span

RESPONSE = "items array<struct<kind:string,text:string,priority:int,confidence:double,tags:array<string>,provenance:array<struct<source_id:string,start:int,end:int>>>>"
# Tags that only the engine itself may set.
RESERVED = [
    "ambiguous-supersession", "correction-derived", "current-value", "detected-conflict", "explicit-correction-label",
    "resolves-protected", "superseded-by-correction", "unlinked-correction", "verifier-recovered",
]


def ask(prompts: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """UD5: history_id and response of a model for each (history_id, prompt), batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"history_id": batch["history_id"], "response": [complete(p) for p in batch["prompt"]]})

    return prompts.select("history_id", "prompt").mapInPandas(run, "history_id string, response string")


def decode(responses: DataFrame, records: DataFrame, name: str = "model", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items and rejections (history_id, place, reason) from JSON responses with spans.

    A claim counts if its kind is known, it cites spans of known records, its text is what each
    span says, the spans are whole atoms, the roles may state it, a fact is not uncertain, and
    no reserved tag is set. A response that is no such object is rejected as a whole.
    """
    parsed = responses.select("history_id", F.from_json("response", RESPONSE).alias("r"))
    broken = parsed.where(F.col("r.items").isNull()).select("history_id", F.lit(-1).alias("place"), F.lit("response").alias("reason"))
    rows = parsed.select("history_id", F.posexplode("r.items").alias("place", "c"))
    spans = rows.select("history_id", "place", "c", F.posexplode_outer("c.provenance").alias("no", "s"))
    own = records.select("history_id", "source_id", "sequence", "role", "content", "trusted", "untrusted")
    spans = spans.withColumn("source_id", F.col("s.source_id")).join(own, ["history_id", "source_id"], "left")
    quote = F.substring("content", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    inside = (F.col("s.start") >= 0) & (F.col("s.end") > F.col("s.start")) & (F.col("s.end") <= F.length("content"))
    kind = F.col("c.kind")
    known = F.coalesce(kind.isin(list(lx.KINDS)), F.lit(False))
    reason = (
        F.when(~known, "kind")
        .when(F.coalesce(tx.strip(F.col("c.text")), F.lit("")) == "", "text")
        .when(F.coalesce(F.arrays_overlap("c.tags", F.array(*[F.lit(t) for t in RESERVED])), F.lit(False)), "tag")
        .when(F.col("no").isNull() | F.col("content").isNull() | ~F.coalesce(inside, F.lit(False)), "span")
        .when(tx.strip(F.col("c.text")) != tx.strip(quote), "literal")
        .when(~can_author(kind, strict), "authority")
        .when((kind == "confirmed_fact") & tx.like(quote, lx.UNCERTAIN), "uncertain")
        .when(~kind.isin(lx.EXACT) & ~atomic_span(F.col("content"), F.col("s.start"), F.col("s.end"), quote), "atom")
    )
    judged = spans.withColumns({"reason": reason, "quote": quote})
    one = judged.groupBy("history_id", "place").agg(
        F.min("reason").alias("reason"),
        F.first("c").alias("c"),
        F.array_sort(F.collect_list(F.struct("no", F.struct("source_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "quote").alias("p")))).alias("ps"),
        F.max("sequence").alias("sequence"),
        F.array_sort(F.collect_set(F.lower("role"))).alias("roles"),
    )
    rejected = one.where("reason is not null").select("history_id", "place", "reason").unionByName(broken)
    none = F.array().cast("array<string>")
    base = F.element_at(F.create_map(*[F.lit(x) for k, v in lx.KINDS.items() for x in (k, v)]), F.col("c.kind"))
    items = one.where("reason is null").select(
        "history_id",
        F.concat(F.lit("m-"), F.left(tx.hash_of(F.col("c.kind"), F.lower("c.text"), F.col("ps")[0]["p"]["source_id"], F.col("ps")[0]["p"]["start"], F.col("ps")[0]["p"]["end"]), F.lit(24))).alias("id"),
        F.col("c.kind").alias("kind"),
        tx.strip(F.col("c.text")).alias("text"),
        F.lit("active").alias("status"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("c.priority", base))).cast("int").alias("priority"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c.confidence", F.lit(1.0)))).alias("confidence"),
        F.col("c.kind").isin(lx.EXACT).alias("exact"),
        F.coalesce("c.tags", none).alias("tags"),
        none.alias("supersedes"),
        none.alias("conflicts_with"),
        F.transform("ps", lambda p: p["p"]).alias("provenance"),
        "sequence",
        "roles",
        F.array(F.lit(name)).alias("extractors"),
    )
    return items.select(*COLUMNS), rejected


def composite(**parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of several extractors' items, and how many each gave (name, n_items)."""
    whole, counts = None, None
    for name, items in parts.items():
        n = items.agg(F.count("*").alias("n_items")).select(F.lit(name).alias("name"), "n_items")
        own = items.select(*COLUMNS)
        whole, counts = (own, n) if whole is None else (whole.unionByName(own), counts.unionByName(n))
    if whole is None:
        raise ValueError("no extractors")
    return whole, counts
