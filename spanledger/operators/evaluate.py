"""Evaluation: baselines, span matching, precision and recall, paired bootstrap, splits (E2, E1, E4-E6, parts of E3, E7, E9 and E10, AG7-AG15, J13-J16, K8, U4, U5, W11, W12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tables import unnest


def truncate(records: DataFrame, budget_chars: int, tail: bool = False) -> DataFrame:
    """The first or last characters of each history within a budget; the record at the edge is cut.

    Contents are joined by a line feed, which counts.
    """
    order = F.desc("sequence") if tail else F.asc("sequence")
    before = Window.partitionBy("history_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    text = F.coalesce("content", F.lit(""))
    used = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))
    left = F.lit(budget_chars) - used
    cut = F.when(F.length(text) <= left, text).when(F.lit(tail), F.substring(text, (F.length(text) - left + 1).cast("int"), left.cast("int"))).otherwise(F.substring(text, F.lit(1), left.cast("int")))
    rows = records.withColumns({"_left": left, "_cut": cut}).where("_left > 0")
    return rows.select("history_id", "source_id", "sequence", F.col("_cut").alias("content"))


def rarity(records: DataFrame) -> DataFrame:
    """AG12: each token's record frequency in its history and its rarity, ln((n + 1) / (df + 1))."""
    own = unnest(records, ["history_id", "source_id"], tx.token_set(F.col("content")), "token")
    df = own.groupBy("history_id", "token").agg(F.count_distinct("source_id").alias("df"))
    total = records.groupBy("history_id").agg(F.count_distinct("source_id").alias("n"))
    return df.join(total, "history_id").withColumn("rarity", F.log((F.col("n") + 1) / (F.col("df") + 1)))


def extractive(records: DataFrame, budget_chars: int) -> DataFrame:
    """Records by mean rarity of their tokens, the best first, each if it still fits."""
    scored = unnest(records, ["history_id", "source_id"], tx.token_set(F.col("content")), "token").join(rarity(records), ["history_id", "token"])
    scored = scored.groupBy("history_id", "source_id").agg(F.avg("rarity").alias("score"))
    rows = records.join(scored, ["history_id", "source_id"], "left")
    entry = F.struct((-F.coalesce("score", F.lit(0.0))).alias("rank"), "sequence", "source_id", (F.length("content") + 1).alias("size"))
    ordered = rows.groupBy("history_id").agg(F.array_sort(F.collect_list(entry)).alias("es"))
    first = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("ids"))
    take = lambda s, e: F.when(s["used"] + e["size"] <= budget_chars, F.struct((s["used"] + e["size"]).alias("used"), F.concat(s["ids"], F.array(e["source_id"])).alias("ids"))).otherwise(s)
    return ordered.select("history_id", F.aggregate("es", first, take).alias("c")).select("history_id", F.col("c.ids").alias("chosen"), F.col("c.used").alias("chars"))


def atom_matches(gold: DataFrame, claims: DataFrame) -> DataFrame:
    """Gold atoms (history_id, atom_id, kind, text, source_id, start, end) with hit, whether a claim
    of the same kind has the same span and normal text."""
    c = claims.select("history_id", "kind", tx.normal(F.col("text")).alias("norm"), F.explode("provenance").alias("p"))
    c = c.select("history_id", "kind", "norm", F.col("p.source_id").alias("source_id"), F.col("p.start").alias("start"), F.col("p.end").alias("end")).distinct().withColumn("_hit", F.lit(True))
    out = gold.withColumn("norm", tx.normal(F.col("text"))).join(c, ["history_id", "kind", "norm", "source_id", "start", "end"], "left")
    return out.withColumn("hit", F.col("_hit").isNotNull()).drop("_hit", "norm")


def overlaps(left: DataFrame, right: DataFrame, width: int = 256) -> DataFrame:
    """Pairs of spans (history_id, source_id, start, end, id) that overlap.

    Spans are dealt to buckets of ``width`` characters, so the join is on equality; a pair is
    reported in the bucket where the later of the two begins.
    """

    def dealt(df: DataFrame, n: str) -> DataFrame:
        buckets = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
        rows = df.where("end > start").withColumn("bucket", F.explode(buckets))
        return rows.select("history_id", "source_id", "bucket", *[F.col(c).alias(f"{n}_{c}") for c in ("id", "start", "end")])

    met = dealt(left, "l").join(dealt(right, "r"), ["history_id", "source_id", "bucket"])
    met = met.where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))
    return met.where(F.col("bucket") == F.floor(F.greatest("l_start", "r_start") / width)).drop("bucket")


def prf(expected: DataFrame, predicted: DataFrame, key: list[str], by: str) -> DataFrame:
    """AG9, U5: true and false positives and false negatives of two multisets, by one of their columns."""
    e = expected.groupBy(*key).agg(F.count("*").alias("e"))
    p = predicted.groupBy(*key).agg(F.count("*").alias("p"))
    zero = F.lit(0).cast("bigint")
    both = e.join(p, key, "full_outer").withColumns({"e": F.coalesce("e", zero), "p": F.coalesce("p", zero)})
    hit = F.least("e", "p")
    out = both.groupBy(by).agg(F.sum(hit).alias("tp"), F.sum(F.col("p") - hit).alias("fp"), F.sum(F.col("e") - hit).alias("fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(1.0))
    return out.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def pooled(rows: DataFrame, hits: str, total: str) -> DataFrame:
    """AG7, AG8: pooled ratio and mean of histories' ratios; a ratio of nothing to nothing is 1."""
    one = F.coalesce(F.col(hits) / F.nullif(F.col(total), F.lit(0)), F.lit(1.0))
    own = rows.withColumn("_r", one)
    return own.agg(
        F.coalesce(F.sum(hits) / F.nullif(F.sum(total), F.lit(0)), F.lit(1.0)).alias("pooled"),
        F.avg("_r").alias("mean"),
        F.count("*").alias("n_histories"),
    )


def harmonic(*metrics: Column) -> Column:
    """AG8: the harmonic mean of several metrics of one row, 0 if any is not above 0."""
    above = F.lit(True)
    for m in metrics:
        above = above & (m > 0)
    return F.when(above, F.lit(float(len(metrics))) / sum((F.lit(1.0) / m for m in metrics[1:]), F.lit(1.0) / metrics[0])).otherwise(0.0)


def latency(rows: DataFrame, column: str) -> DataFrame:
    """AG10: mean, median and nearest-rank 95th percentile."""
    return rows.agg(F.avg(column).alias("mean"), F.median(column).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {column})").alias("p95"))


def bootstrap_bound(pairs: DataFrame, samples: int = 2000, quantile: float = 0.025, seed: int = 7) -> DataFrame:
    """AG11, J15: lower bound of the mean difference of paired cases (case_id, a, b), resampled by hash.

    Each sample draws as many cases as there are; draw k of sample s is case hash(seed, s, k)
    modulo the number of cases, so a rerun gives the same bound. Cases are few (one per
    benchmark history) and are broadcast only as such.
    """
    order = Window.orderBy("case_id")
    cases = pairs.select((F.row_number().over(order) - 1).cast("bigint").alias("n"), (F.col("a") - F.col("b")).alias("d"))
    total = cases.count()
    draws = pairs.sparkSession.range(samples * max(total, 1)).select(
        (F.col("id") / F.lit(max(total, 1))).cast("bigint").alias("sample"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1))).alias("n")
    )
    means = draws.join(cases, "n").groupBy("sample").agg(F.avg("d").alias("mean"))
    return means.agg(F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY mean)").alias("lower"), F.count("*").alias("n_samples"))


def strongest(results: DataFrame) -> DataFrame:
    """AG14: the best system by recall, exact recall, quality and name."""
    return results.agg(F.max_by("system", F.struct("recall", "exact_recall", "quality", "system")).alias("system"))


def adjudicate(first: DataFrame, second: DataFrame, decisions: DataFrame) -> DataFrame:
    """Final labels (history_id, label): what both annotators say, and of the rest what was accepted or put in place.

    decisions has history_id, label, resolution (accept, reject or replace) and replacement.
    """
    a, b = first.select("history_id", "label").distinct(), second.select("history_id", "label").distinct()
    agreed = a.intersect(b)
    open_ = a.unionByName(b).distinct().join(agreed, ["history_id", "label"], "left_anti")
    settled = open_.join(decisions, ["history_id", "label"])
    taken = settled.where("resolution = 'accept'").select("history_id", "label")
    put = settled.where("resolution = 'replace'").select("history_id", F.col("replacement").alias("label"))
    return agreed.unionByName(taken).unionByName(put).distinct()


def leakage(assignments: DataFrame, group: str) -> DataFrame:
    """AG13: groups whose rows fall into more than one split."""
    return assignments.groupBy(group).agg(F.count_distinct("split").alias("n_splits"), F.count("*").alias("n_rows")).where("n_splits > 1")


def reconcile(reported: DataFrame, recomputed: DataFrame, key: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """AG15, E10: values that a report states and a recount does not give."""
    own = recomputed.select(*key, *[F.col(v).alias(f"_{v}") for v in values])
    joined = reported.join(own, key, "full_outer")
    off = lambda v: F.coalesce(F.abs(F.col(v) - F.col(f"_{v}")) > tolerance, ~F.col(v).eqNullSafe(F.col(f"_{v}")))
    wrong = F.filter(F.array(*[F.when(off(v), F.lit(v)) for v in values]), lambda v: v.isNotNull())
    return joined.select(*key, F.explode(wrong).alias("value"))


def without_gold(records: DataFrame, *labels: str) -> DataFrame:
    """K8: records without label columns."""
    return records.drop(*labels)


def supported(text: Column, quote: Column) -> Column:
    """A claim's tokens appear in the quote in order, with the same polarity."""
    from ..functions import lexicon as lx

    claim, said = tx.support_tokens(text), tx.support_tokens(quote)
    reached = F.aggregate(said, F.lit(0), lambda at, t: at + F.when(F.get(claim, at) == t, 1).otherwise(0))
    return (reached == F.size(claim)) & (tx.like(text, lx.V_NEGATION) == tx.like(quote, lx.V_NEGATION))


def tight() -> Column:
    """Whether every span of a claim (kind, text, provenance) says the claim and no more; a conflict's spans lie within its text."""
    claim = tx.normal(F.col("text"))
    between = (F.col("kind") == "unresolved") & F.startswith("text", F.lit("Unresolved source conflict:"))

    def says(p: Column) -> Column:
        quote = tx.normal(p["quote"])
        return F.coalesce((quote == claim) | (between & (quote != "") & F.contains(claim, quote)), F.lit(False))

    return (F.coalesce(F.size("provenance"), F.lit(0)) > 0) & F.forall("provenance", says)


def rendered_contains(rendered: Column, text: Column) -> Column:
    """Whether a prompt states a text; one that stands within 40 characters behind a negation and has none itself is not stated."""
    from ..functions import lexicon as lx

    hay, needle = tx.normal(rendered), tx.normal(text)
    at = F.instr(hay, needle)
    first = F.greatest(at - 40, F.lit(1))
    before = F.substring(hay, first, at - first)
    return (at > 0) & (tx.like(needle, lx.V_NEGATION) | ~tx.like(before, lx.V_NEGATION))


def authority_violations(claims: DataFrame, records: DataFrame, negatives: DataFrame, gated: list[str], trusted: list[str]) -> DataFrame:
    """(history_id, id) of claims that overlap a span that may state nothing, and of gated kinds that rest on an untrusted role or on no record."""
    spans = claims.select("history_id", "id", "kind", F.explode_outer("provenance").alias("p")).select("history_id", "id", "kind", F.col("p.source_id").alias("source_id"), F.col("p.start").alias("start"), F.col("p.end").alias("end"))
    hit = overlaps(spans.where("source_id is not null"), negatives).select("history_id", F.col("l_id").alias("id"))
    known = spans.where(F.col("kind").isin(gated)).join(records.select("history_id", "source_id", "role"), ["history_id", "source_id"], "left")
    roles = known.groupBy("history_id", "id").agg(F.count("role").alias("n"), F.count_if(~F.lower("role").isin(trusted)).alias("odd"))
    return hit.unionByName(roles.where("n = 0 or odd > 0").select("history_id", "id")).distinct()


def history_metrics(gold: DataFrame, claims: DataFrame, prompts: DataFrame) -> DataFrame:
    """Per history of gold atoms (with exact, whether their words must stay): atoms, hits, exact ones, hits stated in the prompt, claims and tight claims, with recall and precision.

    Ratios of nothing are 1. A history without claims or a prompt counts with none.
    """
    hits = atom_matches(gold, claims).join(prompts.select("history_id", "prompt"), "history_id", "left")
    told = F.coalesce(rendered_contains(F.col("prompt"), F.col("text")), F.lit(False))
    own = hits.groupBy("history_id").agg(
        F.count("*").alias("atoms"), F.count_if("hit").alias("hits"), F.count_if("exact").alias("exact_atoms"), F.count_if(F.col("exact") & F.col("hit")).alias("exact_hits"), F.count_if(told).alias("rendered")
    )
    made = claims.groupBy("history_id").agg(F.count("*").alias("claims"), F.count_if(tight()).alias("tight"))
    out = own.join(made, "history_id", "left").fillna(0, ["claims", "tight"])
    ratio = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    return out.withColumns({"recall": ratio("hits", "atoms"), "exact_recall": ratio("exact_hits", "exact_atoms"), "precision": F.when(F.col("claims") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("hits") / F.col("claims"))), "tight_share": ratio("tight", "claims")})


def compare_systems(cases: DataFrame, margin: float = 0.0) -> DataFrame:
    """E5: wins, ties, losses and invalid cases of system a against b, per group.

    cases has group, a, b and valid. A case that is not valid, or has no number, is invalid
    and never a win; ahead is true where more than half of all cases are wins.
    """
    usable = F.col("valid") & F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.isnan("a") & ~F.isnan("b")
    apart = F.col("a") - F.col("b")
    outcome = F.when(~F.coalesce(usable, F.lit(False)), "invalid").when(apart > margin, "win").when(apart < -margin, "loss").otherwise("tie")
    rows = cases.select("group", outcome.alias("outcome"))
    out = rows.groupBy("group").agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("win", "wins"), ("tie", "ties"), ("loss", "losses"), ("invalid", "invalid"))])
    total = F.col("wins") + F.col("ties") + F.col("losses") + F.col("invalid")
    return out.withColumn("ahead", F.col("wins") * 2 > total)


def gates(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """Which gates each row fails, in the order of rules, and whether it is certified; a gate that cannot be decided fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda n: n.isNotNull())
    return rows.select(*key, failed.alias("failed")).withColumn("certified", F.size("failed") == 0)
