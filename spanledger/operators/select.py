"""Budgeted selection and rendering of a ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx

OPEN, CLOSE = '<typed_memory schema="1.0" content="untrusted-jsonl">', "</typed_memory>"


@dataclass(frozen=True)
class Policy:
    """What may be chosen, and how much."""

    token_budget: int = 4000
    minimum_ratio: float = 5.0
    chars_per_token: float = 4.0
    include_superseded: bool = False
    include_discarded: bool = False


def protected(kind: Column, tags: Column) -> Column:
    """D7."""
    return kind.isin(lx.PROTECTED) | F.array_contains(tags, "resolves-protected")


def tokens_of(length: Column, policy: Policy) -> Column:
    """B1."""
    return F.greatest(F.lit(1), F.ceil(length / F.lit(policy.chars_per_token))).cast("bigint")


def prompt_line(items: DataFrame) -> Column:
    """K2: an item as one line of JSON that can't be mistaken for markup."""
    refs = F.transform(
        "provenance",
        lambda s: F.concat(s["source_id"], F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit("#"), F.left(F.sha2(s["quote"].cast("binary"), 256), F.lit(10))),
    )
    payload = F.to_json(F.struct("text", "status", "exact", F.col("roles").alias("source_roles"), refs.alias("provenance")))
    for char, code in (("\u0085", "0085"), ("\u2028", "2028"), ("\u2029", "2029"), ("<", "003c"), (">", "003e"), ("&", "0026")):
        payload = F.replace(payload, F.lit(char), F.lit(f"\\u{code}"))
    return F.concat(F.lit("- "), payload)


def eligible(items: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """P4."""
    rows = items
    if not policy.include_superseded:
        rows = rows.where("status <> 'superseded'")
    if not policy.include_discarded:
        rows = rows.where("status <> 'discarded' and kind <> 'discarded_attempt'")
    return rows


def ordered_entries(items: DataFrame, policy: Policy = Policy(), lines: bool = False) -> DataFrame:
    """history_id and entries: eligible items in the order in which they are chosen, protected ones first; with their lines if asked."""
    rows = eligible(items, policy).withColumn("line", prompt_line(items)).withColumn("size", F.length("line") + 1)
    guard = protected(F.col("kind"), F.col("tags"))
    cost = tokens_of(F.length("kind") + F.length("line") + 3, policy)
    entry = F.struct(
        (~guard).alias("optional"),
        F.when(guard, F.col("kind")).alias("by_kind"),
        F.when(guard, F.col("sequence")).alias("by_sequence"),
        F.when(~guard, -F.col("priority")).alias("by_priority"),
        F.when(~guard, -F.col("confidence")).alias("by_confidence"),
        F.when(~guard, -F.col("sequence")).alias("by_recency"),
        F.when(~guard, cost).alias("by_cost"),
        F.when(~guard, F.struct("sequence", "kind")).alias("by_ledger"),
        "id",
        "kind",
        "size",
        *(["sequence", "line"] if lines else []),
    )
    return rows.groupBy("history_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def select(items: DataFrame, source_chars: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row per history: what is chosen, in order, and the account of tokens.

    source_chars has history_id and n_chars, the length of all contents with a line feed
    between. Protected items are always chosen. Optional ones follow greedily by priority,
    confidence, recency and cost, each if the whole prompt still fits; one that does not fit
    is skipped. The prompt's length is additive, so the fold keeps a sum: the envelope, a line
    per item, and a heading for each kind at its first item. A history without items chooses
    nothing.
    """
    ordered = ordered_entries(items, policy)
    joined = source_chars.join(ordered, "history_id", "left").withColumn("entries", F.coalesce("entries", F.array()))
    floor = F.aggregate(
        F.filter("entries", lambda e: ~e["optional"]),
        F.struct(F.lit(len(OPEN) + len(CLOSE) + 1).alias("chars"), F.array().cast("array<string>").alias("kinds")),
        lambda s, e: F.struct((s["chars"] + _added(s["kinds"], e)).alias("chars"), F.array_union(s["kinds"], F.array(e["kind"])).alias("kinds")),
    )
    joined = joined.withColumns({"_floor": floor, "source_tokens": tokens_of(F.col("n_chars"), policy)})
    protected_tokens = tokens_of(F.col("_floor.chars"), policy)
    target = F.floor(F.col("source_tokens") / F.lit(policy.minimum_ratio))
    budget = F.when(target >= protected_tokens, F.least(F.lit(policy.token_budget), target)).otherwise(F.lit(policy.token_budget))
    joined = joined.withColumns({"protected_tokens": protected_tokens, "budget": budget.cast("bigint")})

    def take(state: Column, e: Column) -> Column:
        chars = state["chars"] + _added(state["kinds"], e)
        fits = tokens_of(chars, policy) <= F.col("budget")
        return F.struct(
            F.when(fits, chars).otherwise(state["chars"]).alias("chars"),
            F.when(fits, F.array_union(state["kinds"], F.array(e["kind"]))).otherwise(state["kinds"]).alias("kinds"),
            F.when(fits, F.concat(state["ids"], F.array(e["id"]))).otherwise(state["ids"]).alias("ids"),
        )

    first = F.struct(
        F.col("_floor.chars").alias("chars"), F.col("_floor.kinds").alias("kinds"), F.transform(F.filter("entries", lambda e: ~e["optional"]), lambda e: e["id"]).alias("ids")
    )
    chosen = F.aggregate(F.filter("entries", lambda e: e["optional"]), first, take)
    out = joined.withColumn("_chosen", chosen).withColumn("prompt_tokens", tokens_of(F.col("_chosen.chars"), policy))
    return out.select(
        "history_id",
        F.col("_chosen.ids").alias("selected"),
        "source_tokens",
        "protected_tokens",
        "budget",
        "prompt_tokens",
        F.col("_chosen.chars").cast("bigint").alias("prompt_chars"),
        F.greatest(F.lit(0), F.col("prompt_tokens") - policy.token_budget).cast("bigint").alias("overflow"),
        (F.col("source_tokens") / F.col("prompt_tokens")).alias("ratio"),
        (F.col("source_tokens") / F.col("prompt_tokens") >= policy.minimum_ratio).alias("target_met"),
    )


def _added(kinds: Column, e: Column) -> Column:
    """Characters that an item adds to the prompt: its line, and its kind's heading if that is new."""
    return (e["size"] + F.when(F.array_contains(kinds, e["kind"]), 0).otherwise(F.length(e["kind"]) + 2)).cast("int")


def render(items: DataFrame, selected: DataFrame) -> DataFrame:
    """K2: history_id and prompt, items grouped by kind in the order of kinds, then as in the ledger."""
    order = F.element_at(F.create_map(*[F.lit(x) for n, k in enumerate(lx.KINDS) for x in (k, n)]), F.col("kind"))
    picked = selected.select("history_id", F.explode("selected").alias("id"))
    rows = items.join(picked, ["history_id", "id"]).withColumn("line", prompt_line(items)).withColumn("rank", order)
    groups = rows.groupBy("history_id", "kind", "rank").agg(
        F.concat(F.col("kind"), F.lit(":\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "id", "line"))), lambda e: e["line"]), "\n")).alias("block")
    )
    body = groups.groupBy("history_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "\n").alias("body"))
    whole = selected.select("history_id").join(body, "history_id", "left")
    return whole.select("history_id", F.concat_ws("\n", F.lit(OPEN), F.col("body"), F.lit(CLOSE)).alias("prompt"))
