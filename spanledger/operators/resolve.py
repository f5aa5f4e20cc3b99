"""From extracted items to a ledger: merging, corrections, closed questions, contradictions (R1-R10, AG1, J3-J5).

Everything is keyed by history_id. What may replace, answer or contradict what is found by joins
and scored pair by pair in columns. Only liveness depends on order: whether a rival is still
there when a correction or an answer is reached. That is a fold over each history's scored
pairs, of which only those near the threshold are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.tables import remembered, settle, unnest

COLUMNS = [
    "history_id", "id", "kind", "text", "status", "priority", "confidence", "exact", "tags", "supersedes",
    "conflicts_with", "provenance", "sequence", "roles", "extractors",
]
REPLACEABLE = ["goal", "constraint", "confirmed_fact", "decision", "exact_reference"]
CONFLICT_KINDS = ["constraint", "confirmed_fact", "decision"]


def item_id(kind: Column, norm: Column) -> Column:
    return F.concat(F.lit("m-"), F.left(tx.hash_of(kind, norm), F.lit(24)))


def _union(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def canonicalize(items: DataFrame) -> DataFrame:
    """AG1: items of one kind and normal text become one.

    The earliest row gives the text; spans are joined in order of appearance; the status is
    that of the latest sequence, of equal ones the one that ranks higher.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for k, v in lx.STATUS_RANK.items() for x in (k, v)]), F.col("status"))
    age = F.struct("sequence", "id")
    spans = F.array_sort(F.collect_list(F.struct("sequence", "id", "provenance")))
    return (
        items.withColumn("norm", tx.normal(F.col("text")))
        .groupBy("history_id", "kind", "norm")
        .agg(
            F.min_by("text", age).alias("text"),
            F.max_by("status", F.struct(F.col("sequence"), rank)).alias("status"),
            F.max("priority").alias("priority"),
            F.max("confidence").alias("confidence"),
            F.bool_or("exact").alias("exact"),
            _union("tags").alias("tags"),
            _union("supersedes").alias("supersedes"),
            _union("conflicts_with").alias("conflicts_with"),
            F.array_distinct(F.flatten(F.transform(spans, lambda s: s["provenance"]))).alias("provenance"),
            F.max("sequence").alias("sequence"),
            _union("roles").alias("roles"),
            _union("extractors").alias("extractors"),
        )
        .withColumn("id", item_id(F.col("kind"), F.col("norm")))
        .select(*COLUMNS)
    )


@remembered
def _traits() -> tuple[dict[str, Column], dict[str, Column], Column]:
    text = F.col("text")
    toks = tx.token_set(text)
    after = F.nullif(F.regexp_extract(text, lx.DATABASE_AFTER, 1), F.lit(""))
    database = F.coalesce(F.nullif(F.regexp_extract(text, lx.DATABASE, 1), F.lit("")), after)
    scopes = F.create_map(*[F.lit(x) for k, v in lx.SCOPES.items() for x in (k, v)])
    return (
        {
            "tokens": toks,
            "negated": tx.like(text, lx.NEGATION),
            "database": tx.strip_chars(F.lower(database), ".,;:"),
            "revokes": tx.like(text, lx.REVOCATION),
            "adds": tx.like(text, lx.ADDITIVE),
            "replaces": tx.like(text, lx.REPLACEMENT),
            "marked": tx.like(text, lx.CORRECTION_MARKER),
            "commitments": F.size(F.regexp_extract_all(text, F.lit(lx.COMMITMENT), F.lit(0))),
            "confirms": tx.like(text, lx.CONFIRMATION),
            "exclusive": tx.like(text, lx.EXCLUSIVE) & ~tx.like(text, lx.NOT_EXCLUSIVE),
        },
        {
            "scope": F.array_distinct(F.filter(F.transform("tokens", lambda t: F.try_element_at(scopes, t)), lambda s: s.isNotNull())),
            "numbers": F.filter("tokens", lambda t: t.rlike(r"(?U)\d")),
            "words": F.filter("tokens", lambda t: ~t.rlike(r"(?U)\d")),
        },
        F.when(F.size("scope") == 1, F.get("scope", F.lit(0))),
    )


def traits(items: DataFrame) -> DataFrame:
    """What the rules need to know of each text, found once."""
    first, second, scope = _traits()
    return items.withColumns(first).withColumns(second).withColumn("scope", scope)


#: What a pair of items is judged by.
JUDGED = [
    "kind", "sequence", "text", "priority", "confidence", "tags", "tokens", "words", "numbers", "negated", "exclusive", "scope", "database",
    "subject", "revokes", "adds", "replaces", "commitments", "provenance", "roles",
]


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _shared(x: Column, y: Column, field: str) -> Column:
    return F.size(F.array_intersect(x[field], y[field]))


def opposed(x: Column, y: Column) -> Column:
    """Two texts that differ in one database or in one antonym, and name no different scopes."""
    apart = F.coalesce(x["scope"] != y["scope"], F.lit(False))
    out = F.coalesce((x["database"] != y["database"]) & (x["subject"] == y["subject"]), F.lit(False))
    for one, two in lx.ANTONYMS:
        rest = [_without(s["tokens"], one, two) for s in (x, y)]
        facing = (F.array_contains(x["tokens"], one) & F.array_contains(y["tokens"], two)) | (F.array_contains(x["tokens"], two) & F.array_contains(y["tokens"], one))
        out = out | (facing & (F.size(rest[0]) > 0) & (rest[0] == rest[1]))
    return ~apart & out


def _without(tokens: Column, one: str, two: str) -> Column:
    return F.array_sort(F.array_except(tokens, F.array(F.lit(one), F.lit(two))))


def replaceable(c: Column, p: Column, kind: Column, against: Column) -> Column:
    """Whether correction c has evidence that it replaces p, taken as an item of the given kind; against says if they are opposed."""
    words = _shared(c, p, "words")
    firm = (kind == "constraint") & (p["commitments"] > 1)
    only_adds = c["adds"] & ~c["replaces"]
    evidence = F.array(
        c["replaces"] & (_shared(c, p, "tokens") > 0),
        (F.size(c["numbers"]) > 0) & (F.size(p["numbers"]) > 0) & ~F.arrays_overlap(c["numbers"], p["numbers"]) & (words > 0),
        (c["negated"] != p["negated"]) & (words >= 2),
        against,
    )
    return ~firm & ~only_adds & F.exists(evidence, lambda e: e)


def replacement_score(c: Column, p: Column, kind: Column, against: Column) -> Column:
    """How well correction c fits p, taken as an item of the given kind, from 0 to 1."""
    both = F.array_intersect(c["tokens"], p["tokens"])
    share = F.size(both) / F.least(F.size(c["tokens"]), F.size(p["tokens"]))
    named = F.exists(both, lambda t: t.rlike(r"(?U)[\d/\\\\.]"))
    whole = (F.size(p["tokens"]) <= 2) & (F.size(F.array_except(p["tokens"], c["tokens"])) == 0)
    thin = (kind != "exact_reference") & (_shared(c, p, "words") < 2) & ~whole
    base = share + F.when(named, lx.IDENTIFIER).otherwise(0.0)
    base = F.when(thin, F.least(base, F.lit(lx.THIN))).otherwise(base)
    least = F.when(against, lx.OPPOSED).when(c["revokes"] & (F.size(both) > 0), lx.REVOKED).otherwise(0.0)
    empty = (F.size(c["tokens"]) == 0) | (F.size(p["tokens"]) == 0)
    return F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(base, least)))


def _judged(items: DataFrame) -> DataFrame:
    """(history_id, id, j) with what pairs are judged by."""
    own = traits(items).withColumn("subject", F.array_sort(F.array_except("tokens", F.concat(F.array(*[F.lit(w) for w in lx.DATABASE_WORDS]), F.array(F.coalesce("database", F.lit("")))))))
    return own.select("history_id", "id", F.struct(*JUDGED).alias("j"))


def _earlier(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pairs of judged items (history_id, own, other) that share a token or both name a database, other being earlier."""
    database = F.when(F.col("j.database").isNotNull(), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    keys = lambda df, n: df.select("history_id", F.struct("id", "j").alias(n), F.explode(F.concat("j.tokens", database)).alias("key"))
    met = keys(later, "own").join(keys(earlier, "other"), ["history_id", "key"]).where(F.col("other.j.sequence") < F.col("own.j.sequence"))
    # A pair that shares several keys counts at the first of them.
    shared = F.array_intersect(F.col("own.j.tokens"), F.col("other.j.tokens"))
    first = F.when(F.size(shared) > 0, F.get(shared, F.lit(0))).otherwise(F.lit(""))
    return met.where(F.col("key") == first).select("history_id", "own", "other")


def _ranked(pairs: DataFrame, score: Column, least: float, **more: Column) -> DataFrame:
    """(history_id, id, rivals): each item's candidates that can win or block, best score first, then the latest.

    What scores further below the threshold than the gap can do neither.
    """
    scored = pairs.withColumn("score", score).where(F.col("score") > least - lx.GAP - 1e-9)
    rival = F.struct((-F.col("score")).alias("rank"), (-F.col("other.j.sequence")).alias("age"), F.col("other.id").alias("id"), *[c.alias(k) for k, c in more.items()])
    return scored.groupBy("history_id", F.col("own.id").alias("id")).agg(F.array_sort(F.collect_list(rival)).alias("rivals"))


def _verdict(rivals: Column, least: float) -> Column:
    """Weak, unclear or clear, by the best of the rivals and the next one's distance."""
    best, second = F.get(rivals, F.lit(0)), F.get(rivals, F.lit(1))
    weak = F.coalesce(-best["rank"] < least, F.lit(True))
    return F.when(weak, "weak").when(F.coalesce(second["rank"] - best["rank"] < lx.GAP, F.lit(False)), "unclear").otherwise("clear")


def _changed(items: DataFrame, changes: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """items with changes (history_id, id, tag, target, gone) made: tags and edges added, status superseded where gone.

    marks (history_id, id and others) may add columns.
    """
    each = changes.groupBy("history_id", "id").agg(
        F.collect_set("tag").alias("_tags"), F.collect_set("target").alias("_targets"), F.bool_or("gone").alias("_gone")
    )
    none = F.array().cast("array<string>")
    rows, more = items.join(each, ["history_id", "id"], "left"), []
    if marks is not None:
        rows, more = rows.join(marks, ["history_id", "id"], "left"), [c for c in marks.columns if c not in ("history_id", "id")]
    return rows.select(
        *[c for c in COLUMNS if c not in ("status", "tags", "supersedes")],
        *more,
        F.when(F.coalesce("_gone", F.lit(False)), "superseded").otherwise(F.col("status")).alias("status"),
        F.array_sort(F.array_union("tags", F.coalesce("_tags", none))).alias("tags"),
        F.array_sort(F.array_union("supersedes", F.coalesce("_targets", none))).alias("supersedes"),
    )


MADE = "array<struct<id:string,kind:string,priority:int,sequence:bigint>>"
LINK = "struct<own:string,verdict:string,prior:string,target:string,heir:string,made:string,kind:string,priority:int>"


def _walk(corrections: Column) -> Column:
    """Links of one history's corrections, taken in order.

    What a correction replaces is no rival any more for the next, and what it puts in its place
    is one: rivals with ``maker`` count only if that correction made an item of their kind.
    """
    first = F.struct(F.array().cast("array<string>").alias("gone"), F.array().cast(MADE).alias("made"), F.array().cast(f"array<{LINK}>").alias("links"))

    def known(state: Column, rival: Column) -> Column:
        return F.get(F.filter(state["made"], lambda m: (m["id"] == rival["id"]) & (m["kind"] == rival["kind"])), F.lit(0))

    def link(state: Column, own: Column, left: Column) -> Column:
        verdict, best = _verdict(left, lx.REPLACES), F.get(left, F.lit(0))
        clear = verdict == "clear"
        stated = F.try_element_at(own["heirs"], best["kind"])
        raised = F.get(F.filter(state["made"], lambda m: (m["kind"] == best["kind"]) & (m["sequence"] == own["sequence"])), F.lit(0))
        heir = F.when(clear & ~own["revokes"], F.coalesce(stated, raised["id"]))
        makes = clear & ~own["revokes"] & heir.isNull()
        priority = F.greatest(F.coalesce(known(state, best)["priority"], best["priority"]), own["priority"])
        return F.struct(
            own["id"].alias("own"), verdict.alias("verdict"), F.when(clear, best["id"]).alias("prior"), F.when(clear, best["target"]).alias("target"),
            heir.alias("heir"), F.when(makes, F.concat(F.lit("r-"), own["id"])).alias("made"), F.when(makes, best["kind"]).alias("kind"), F.when(makes, priority).alias("priority"),
        )

    def step(state: Column, own: Column) -> Column:
        alive = lambda r: ~F.array_contains(state["gone"], r["id"]) & (r["maker"].isNull() | known(state, r).isNotNull())
        return _let(
            _let(F.filter(own["rivals"], alive), lambda left: link(state, own, left)),
            lambda found: F.struct(
                F.when(found["prior"].isNull(), state["gone"]).otherwise(F.concat(state["gone"], F.array(found["prior"]))).alias("gone"),
                F.when(found["made"].isNull(), state["made"]).otherwise(
                    F.concat(state["made"], F.array(F.struct(found["made"].alias("id"), found["kind"].alias("kind"), found["priority"].alias("priority"), own["sequence"].alias("sequence"))))
                ).alias("made"),
                F.concat(state["links"], F.array(found)).alias("links"),
            ),
        )

    return F.aggregate(corrections, first, step, lambda s: s["links"])


def correction_links(items: DataFrame) -> DataFrame:
    """What each correction does (history_id, own, verdict, prior, target, heir, made, kind, priority).

    items are merged. weak: no rival is near enough; unclear: two are as near; clear: prior
    goes, and unless the correction only revokes, an item stated with it (heir) or one made of
    its text (made, of the prior's kind) stands for it. target is prior's id once items are
    merged again.
    """
    live = (F.col("status") == "active") & F.col("kind").isin(REPLACEABLE)
    own = settle(_judged(items.where(live | (F.col("kind") == "user_correction"))))
    labelled = F.array_contains("j.tags", "explicit-correction-label")
    fixes = own.where((F.col("j.kind") == "user_correction") & (tx.like(F.col("j.text"), lx.CORRECTION_MARKER) | labelled))
    priors = own.where(F.col("j.kind") != "user_correction")
    nobody = F.lit(None).cast("string")
    met = _earlier(fixes, priors).select("*", F.col("other.j.kind").alias("as_kind"), F.col("other.id").alias("as_id"), F.col("other.id").alias("target"), nobody.alias("maker"))
    # What an earlier correction may put in place of a prior: its own text, as an item of any of the kinds.
    again = _earlier(fixes, fixes.where(~F.col("j.revokes"))).select("*", F.explode(F.array(*[F.lit(k) for k in REPLACEABLE])).alias("as_kind"))
    again = again.select("*", F.concat(F.lit("r-"), "other.id").alias("as_id"), item_id(F.col("as_kind"), tx.normal(F.col("other.j.text"))).alias("target"), F.col("other.id").alias("maker"))
    pairs = met.unionByName(again)
    c, p, kind = F.col("own.j"), F.col("other.j"), F.col("as_kind")
    pairs = pairs.withColumn("against", opposed(c, p))
    pairs = pairs.where(replaceable(c, p, kind, F.col("against"))).withColumn("other", F.struct(F.col("as_id").alias("id"), p.alias("j")))
    rivals = _ranked(pairs, replacement_score(c, p, kind, F.col("against")), lx.REPLACES, target=F.col("target"), kind=kind, priority=p["priority"], maker=F.col("maker"))
    derived = items.where(F.array_contains("tags", "correction-derived")).groupBy("history_id", "sequence", "kind").agg(F.min("id").alias("heir"))
    heirs = derived.groupBy("history_id", "sequence").agg(F.map_from_entries(F.collect_list(F.struct("kind", "heir"))).alias("heirs"))
    rows = fixes.select("history_id", "id", F.col("j.sequence").alias("sequence"), F.col("j.priority").alias("priority"), F.col("j.revokes").alias("revokes"))
    rows = rows.join(rivals, ["history_id", "id"], "left").join(heirs, ["history_id", "sequence"], "left")
    none = F.array().cast(rivals.schema["rivals"].dataType)
    entry = F.struct("sequence", "id", "priority", "revokes", F.coalesce("heirs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("heirs"), F.coalesce("rivals", none).alias("rivals"))
    # Sorted by hand, since maps have no order.
    walked = rows.select("history_id", "sequence", "id", entry.alias("entry")).groupBy("history_id").agg(
        F.array_sort(F.collect_list("entry"), lambda a, b: F.when(a["sequence"] < b["sequence"], -1).when(a["sequence"] > b["sequence"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("entries")
    )
    return unnest(walked, ["history_id"], _walk(F.col("entries")), "l").select("history_id", "l.*")


def link_corrections(items: DataFrame) -> DataFrame:
    """Merged items with what their corrections did; merged again."""
    links = settle(correction_links(items))
    if links.isEmpty():
        return items
    said = F.when(F.col("verdict") == "weak", "additive-clarification").when(F.col("verdict") == "unclear", "ambiguous-supersession")
    no = F.lit(False)
    nothing = F.lit(None).cast("string")
    clear = links.where("verdict = 'clear'")
    changes = (
        links.select("history_id", F.col("own").alias("id"), said.alias("tag"), "target", no.alias("gone"))
        .unionByName(clear.select("history_id", F.col("prior").alias("id"), F.lit("superseded-by-correction").alias("tag"), nothing.alias("target"), F.lit(True).alias("gone")))
        .unionByName(clear.where("heir is not null").select("history_id", F.col("heir").alias("id"), nothing.alias("tag"), "target", no.alias("gone")))
    )
    made = clear.where("made is not null").select("history_id", F.col("own").alias("id"), "made", F.col("kind").alias("_kind"), F.col("priority").alias("_priority"), "target")
    fresh = items.join(made, ["history_id", "id"]).select(
        "history_id", F.col("made").alias("id"), F.col("_kind").alias("kind"), "text", F.lit("active").alias("status"), F.col("_priority").alias("priority"),
        F.least("confidence", F.lit(lx.DERIVED_CONFIDENCE)).alias("confidence"), "exact",
        F.array_sort(F.array_union("tags", F.array(F.lit("correction-derived"), F.lit("current-value")))).alias("tags"),
        F.array("target").alias("supersedes"), "conflicts_with", "provenance", "sequence", "roles", "extractors",
    )
    # Merged items have one id for each kind and normal text: only those that an item made here is equal to merge again.
    met = fresh.select("history_id", item_id(F.col("kind"), tx.normal(F.col("text"))).alias("id"), F.lit(True).alias("_met")).distinct()
    rows = settle(_changed(items.select(*COLUMNS), changes, met))
    same = F.coalesce("_met", F.lit(False))
    new = _changed(fresh, changes)
    return rows.where(~same).select(*COLUMNS).unionByName(canonicalize(rows.where(same).select(*COLUMNS).unionByName(new)))


def closing_links(items: DataFrame) -> DataFrame:
    """Which open question each confirmation closes (history_id, own, prior): the one it answers clearly, unless it is closed already."""
    marked = (F.col("kind") == "confirmed_fact") & tx.like(F.col("text"), lx.CONFIRMATION)
    stated = F.size(F.array_except(F.transform("roles", F.lower), F.array(*[F.lit(r) for r in lx.STATE_ROLES]))) == 0
    open_ = (F.col("kind") == "unresolved") & ~F.array_contains("tags", "detected-conflict")
    live = items.where("status = 'active'")
    facts, asked = _judged(live.where(marked & stated)), _judged(live.where(open_))
    pairs = _earlier(facts, asked)
    shared = _shared(F.col("own.j"), F.col("other.j"), "tokens")
    score = shared / F.least(F.size("own.j.tokens"), F.size("other.j.tokens"))
    rivals = _ranked(pairs.where(shared >= 2), score, lx.CLOSES).join(facts.select("history_id", "id", F.col("j.sequence").alias("sequence")), ["history_id", "id"])
    walked = rivals.groupBy("history_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "id", "rivals"))).alias("entries"))
    first = F.struct(F.array().cast("array<string>").alias("gone"), F.array().cast("array<struct<own:string,prior:string>>").alias("links"))

    def step(state: Column, own: Column) -> Column:
        left = F.filter(own["rivals"], lambda r: ~F.array_contains(state["gone"], r["id"]))
        return _let(
            F.struct(_verdict(left, lx.CLOSES).alias("verdict"), F.get(left, F.lit(0))["id"].alias("prior")),
            lambda v: F.when(
                v["verdict"] == "clear",
                F.struct(
                    F.concat(state["gone"], F.array(v["prior"])).alias("gone"),
                    F.concat(state["links"], F.array(F.struct(own["id"].alias("own"), v["prior"].alias("prior")))).alias("links"),
                ),
            ).otherwise(state),
        )

    return unnest(walked, ["history_id"], F.aggregate("entries", first, step, lambda s: s["links"]), "l").select("history_id", "l.*")


def close_questions(items: DataFrame) -> DataFrame:
    """Merged items with answered questions superseded; neither kinds nor texts change, so they stay merged."""
    links = settle(closing_links(items))
    if links.isEmpty():
        return items
    changes = links.select("history_id", F.col("own").alias("id"), F.lit("resolves-protected").alias("tag"), F.col("prior").alias("target"), F.lit(False).alias("gone"))
    closed = links.select("history_id", F.col("prior").alias("id"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("target"), F.lit(True).alias("gone"))
    return _changed(items, changes.unionByName(closed)).select(*COLUMNS)


def conflict_pairs(items: DataFrame) -> DataFrame:
    """Contradicting pairs (history_id, kind, left, right, left_, right_), left earlier in the ledger.

    Only items that may contradict are compared. Related ones share so many words that the
    one with fewer shares one of its rarest; opposed ones have the same rest beside an antonym
    or the same subject beside a database. Each of these is a key to meet by.
    """
    own = settle(_judged(items.where((F.col("status") == "active") & F.col("kind").isin(CONFLICT_KINDS))))
    told = own.select("history_id", "id", F.col("j.kind").alias("kind"), F.col("j.words").alias("words"), "j")
    words = told.select("history_id", "kind", "id", F.size("words").alias("n"), F.explode("words").alias("word"))
    rarity = words.groupBy("history_id", "kind", "word").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("history_id", "id").orderBy(F.coalesce("df", F.lit(0)), "word")
    # Of n words n - ceil(share n) + 1 cannot all be missing; words that stand alone meet nobody and come first.
    placed = words.join(rarity, ["history_id", "kind", "word"], "left").withColumn("place", F.row_number().over(order))
    probe = placed.where((F.col("place") <= F.col("n") - F.ceil(F.lit(lx.RELATED) * F.col("n") - F.lit(1e-9)) + 1) & F.col("df").isNotNull())
    a = probe.select("history_id", "kind", "word", F.col("id").alias("one"), F.col("n").alias("one_n"))
    b = placed.where("df is not null").select("history_id", "kind", "word", F.col("id").alias("two"), F.col("n").alias("two_n"))
    met = a.join(b, ["history_id", "kind", "word"]).where((F.col("one") != F.col("two")) & (F.col("one_n") <= F.col("two_n"))).select("history_id", "one", "two")
    rests = F.array(
        *[F.when(F.arrays_overlap("j.tokens", F.array(F.lit(x), F.lit(y))), F.struct(F.lit(k).alias("by"), _without(F.col("j.tokens"), x, y).alias("rest"))) for k, (x, y) in enumerate(lx.ANTONYMS)],
        F.when(F.col("j.database").isNotNull(), F.struct(F.lit(-1).alias("by"), F.col("j.subject").alias("rest"))),
    )
    rest = told.select("history_id", "kind", F.col("id"), F.explode(F.filter(rests, lambda r: r.isNotNull())).alias("rest"))
    facing = rest.select("history_id", "kind", "rest", F.col("id").alias("one")).join(rest.select("history_id", "kind", "rest", F.col("id").alias("two")), ["history_id", "kind", "rest"])
    met = met.unionByName(facing.where("one < two").select("history_id", "one", "two"))
    met = met.select("history_id", F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).distinct()
    side = lambda n: own.select("history_id", F.col("id").alias(n), F.col("j").alias(f"{n}_"))
    pairs = met.join(side("one"), ["history_id", "one"]).join(side("two"), ["history_id", "two"])
    turned = (F.col("one_.sequence") > F.col("two_.sequence")) | ((F.col("one_.sequence") == F.col("two_.sequence")) & (F.col("one") > F.col("two")))
    pick = lambda x, y, n: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(n)
    pairs = pairs.select("history_id", F.col("one_.kind").alias("kind"), pick("one", "two", "left"), pick("two", "one", "right"), pick("one_", "two_", "left_"), pick("two_", "one_", "right_"))
    return pairs.where(contradicts(F.col("left_"), F.col("right_")))


def contradicts(x: Column, y: Column) -> Column:
    """Related texts of different polarity or of exclusive values, or opposed ones."""
    apart = F.coalesce(x["scope"] != y["scope"], F.lit(False))
    shared = _shared(x, y, "words")
    related = (shared >= 1) & (shared / F.greatest(F.lit(1), F.least(F.size(x["words"]), F.size(y["words"]))) >= lx.RELATED)
    bare = [F.array_sort(F.array_except(s["words"], F.array(*[F.lit(w) for w in lx.GENERIC_WORDS]))) for s in (x, y)]
    values = (
        (F.size(x["numbers"]) > 0) & (F.size(y["numbers"]) > 0) & ~F.arrays_overlap(x["numbers"], y["numbers"])
        & x["exclusive"] & y["exclusive"] & (F.size(bare[0]) > 0) & (bare[0] == bare[1])
    )
    return (~apart & related & ((x["negated"] != y["negated"]) | values)) | opposed(x, y)


def mark_conflicts(items: DataFrame) -> DataFrame:
    """Both sides of a contradiction become conflicting, and an open question names them; no side wins."""
    pairs = settle(conflict_pairs(items))
    edges = pairs.select("history_id", F.col("left").alias("id"), F.col("right").alias("other"))
    edges = edges.unionByName(edges.select("history_id", F.col("other").alias("id"), F.col("id").alias("other")))
    edges = edges.groupBy("history_id", "id").agg(F.collect_set("other").alias("others"))
    # Items of CONFLICT_KINDS alone have edges, and what is asked can equal open questions alone.
    question = F.col("kind") == "unresolved"
    marked = items.where(~question).join(edges, ["history_id", "id"], "left").withColumns(
        {
            "status": F.when(F.col("others").isNotNull(), "conflicting").otherwise(F.col("status")),
            "conflicts_with": F.array_sort(F.array_union("conflicts_with", F.coalesce("others", F.array().cast("array<string>")))),
        }
    )
    x, y = F.col("left_"), F.col("right_")
    none = F.array().cast("array<string>")
    asked = pairs.select(
        "history_id",
        F.concat_ws("-", F.lit("c"), F.least("left", "right"), F.greatest("left", "right")).alias("id"),
        F.lit("unresolved").alias("kind"),
        F.concat(F.lit('Unresolved source conflict: "'), x["text"], F.lit('" versus "'), y["text"], F.lit('"')).alias("text"),
        F.lit("active").alias("status"),
        F.lit(100).alias("priority"),
        F.lit(1.0).alias("confidence"),
        F.lit(False).alias("exact"),
        F.array(F.lit("detected-conflict")).alias("tags"),
        none.alias("supersedes"),
        F.array_sort(F.array("left", "right")).alias("conflicts_with"),
        F.concat(x["provenance"], y["provenance"]).alias("provenance"),
        F.greatest(x["sequence"], y["sequence"]).alias("sequence"),
        F.array_sort(F.array_union(x["roles"], y["roles"])).alias("roles"),
        F.array(F.lit("temporal-resolver")).alias("extractors"),
    )
    return marked.select(*COLUMNS).unionByName(canonicalize(items.where(question).select(*COLUMNS).unionByName(asked)))


def resolve(items: DataFrame) -> DataFrame:
    """The ledger of every history."""
    # Each step's table is read several times by the next.
    merged = settle(canonicalize(items))
    corrected = settle(link_corrections(merged))
    return mark_conflicts(settle(close_questions(corrected)))
