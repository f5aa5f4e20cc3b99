"""Claims out of records: lines, labels, sections, classification, exact literals.

Places of lines and sections are folded within each record before its lines become rows, so
nothing is shuffled. Each line gives an array of atoms, each atom an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.tables import remembered, unnest

#: Some word of every diagnostic, in lower case: a text without any holds none.
ERROR_HINT = r"error|exception|traceback|fault|panic|fatal|fail|exit|status|expected|undefined|null|ts\d|^e"
ATOM = "struct<start:int,text:string,kind:string,tags:array<string>,exact:boolean>"
NONE = f"array<{ATOM}>"


def in_role(role: Column, roles: list[str]) -> Column:
    return F.lower(role).isin(roles)


def can_author(kind: Column, strict: bool = False) -> Column:
    """Whether the record's role may state a claim of the kind. strict distrusts marked histories."""
    role = F.col("role")
    fact = in_role(role, lx.STATE_ROLES) | F.col("trusted")
    allowed = (
        F.when(kind.isin(lx.COMMITMENT_KINDS), in_role(role, lx.COMMITMENT_ROLES))
        .when(kind.isin(lx.STATE_KINDS), in_role(role, lx.STATE_ROLES))
        .when(kind == "confirmed_fact", fact)
        .otherwise(F.lit(True))
    )
    return allowed & ~(F.col("untrusted") & kind.isin(lx.UNTRUSTED_KINDS)) if strict else allowed


def atom(start: Column, text: Column, kind: Column, *tags: str) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        text.alias("text"),
        kind.alias("kind"),
        F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"),
        kind.isin(lx.EXACT).alias("exact"),
    )


KEEP = ["history_id", "source_id", "sequence", "role", "trusted", "untrusted"]


def _ended(raw: Column) -> Column:
    """A line without its end."""
    return F.regexp_replace(raw, r"[\r\n]+\z", "")


def _starts(raws: Column) -> Column:
    return tx.folded(raws, F.lit(0), lambda at, raw, _: (at + F.length(raw), F.array(at)))


def lines(records: DataFrame) -> DataFrame:
    """One row per line with its place in the content; blank lines stay."""

    def told(raws: Column) -> Column:
        return tx.bound(_starts(raws), lambda at: F.transform(raws, lambda raw, k: F.struct(F.get(at, k).alias("line_start"), raw.alias("raw"))))

    own = unnest(records, KEEP, tx.bound(tx.line_array(F.coalesce("content", F.lit(""))), told), "l", "pos")
    return own.select(*KEEP, "pos", F.col("l.line_start").alias("line_start"), _ended(F.col("l.raw")).alias("line"))


def semicolon_clauses(text: Column) -> Column:
    """What lies between semicolons, without outer white space."""
    return F.filter(F.transform(tx.pieces(text, ";"), tx.trimmed), lambda p: p["text"] != "")


def constraint_clauses(text: Column) -> Column:
    """Sentences and semicolon clauses, cut at `and` where both sides are requirements."""
    parts = F.filter(F.transform(tx.pieces(text, r";|(?<=[.!?])\s+"), tx.trimmed), lambda p: p["text"] != "")
    return F.flatten(F.transform(parts, _at_and))


def _at_and(part: Column) -> Column:
    whole = part["text"]
    words = tx.pieces(whole, r"(?i)\s+and\s+")

    def cut(state: Column, piece: Column) -> Column:
        # state: clauses cut off so far, and where the clause at hand starts and ends
        left = F.substring(whole, state["from"] + 1, state["to"] - state["from"])
        right = F.substring(whole, piece["start"] + 1, F.length(whole))
        both = (state["to"] > state["from"]) & tx.like(left, lx.CONSTRAINT) & tx.like(right, lx.CONSTRAINT)
        done = F.struct((part["start"] + state["from"]).alias("start"), left.alias("text"))
        return F.struct(
            F.when(both, F.concat(state["done"], F.array(done))).otherwise(state["done"]).alias("done"),
            F.when(both, piece["start"]).otherwise(state["from"]).alias("from"),
            (piece["start"] + F.length(piece["text"])).alias("to"),
        )

    first = F.struct(
        F.array().cast("array<struct<start:int,text:string>>").alias("done"), F.lit(0).alias("from"), F.lit(0).alias("to")
    )
    last = lambda s: F.concat(
        s["done"], F.array(F.struct((part["start"] + s["from"]).alias("start"), F.substring(whole, s["from"] + 1, F.length(whole)).alias("text")))
    )
    return F.when(F.size(words) == 1, F.array(part)).otherwise(F.aggregate(words, first, cut, last))


def classify(text: Column, role: Column, trusted: Column, strict_untrusted: Column | None = None) -> Column:
    """The kind of a free line, or null. The first that fits counts."""
    commits, states = in_role(role, lx.COMMITMENT_ROLES), in_role(role, lx.STATE_ROLES)
    short = F.length(text) <= lx.GOAL_LENGTH
    kind = (
        F.when(commits & tx.like(text, lx.CORRECTION), "user_correction")
        .when(tx.like(text, lx.DISCARDED), "discarded_attempt")
        .when(states & tx.like(text, lx.EPISTEMIC), "unresolved")
        .when(commits & tx.like(text, lx.CONSTRAINT), "constraint")
        .when((F.lower(role) == "user") & short & tx.like(text, lx.REQUEST), "goal")
        .when(commits & short & tx.like(text, lx.IMPERATIVE), "goal")
        .when(states & tx.like(text, lx.UNRESOLVED), "unresolved")
        .when(states & tx.like(text, lx.DECISION), "decision")
        .when(trusted & tx.like(text, lx.FACT), "confirmed_fact")
    )
    if strict_untrusted is None:
        return kind
    return F.when(strict_untrusted & kind.isin("unresolved", "decision", "confirmed_fact"), None).otherwise(kind)


def new_value(text: Column) -> Column:
    """The kind under which a correction also states its new value, or null."""
    return (
        F.when(tx.like(text, lx.REVOCATION), None)
        .when(tx.like(text, lx.CONSTRAINT) | tx.like(text, lx.KEEPS), "constraint")
        .when(tx.like(text, lx.UNRESOLVED), "unresolved")
        .when(tx.like(text, lx.FACT), "confirmed_fact")
        .when(tx.like(text, lx.DECISION), "decision")
    )


def references(text: Column) -> Column:
    """Exact references, none inside another."""
    # All patterns need a slash, but that of tests, which needs two colons behind .py.
    possible = F.contains(text, F.lit("/")) | F.contains(text, F.lit("\\")) | F.contains(text, F.lit("::"))
    return F.when(possible, _references(text)).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def _references(text: Column) -> Column:
    found = F.concat(*[tx.matches(text, p) for p in lx.REFERENCES.values()])
    ranked = F.array_sort(
        F.array_distinct(F.transform(found, lambda m: F.struct(m["start"].alias("start"), (-F.length(m["text"])).alias("rank"), m["text"].alias("text"))))
    )
    inside = lambda x, i: F.exists(
        F.slice(ranked, F.lit(1), i), lambda y: (y["start"] <= x["start"]) & (y["start"] - y["rank"] >= x["start"] - x["rank"])
    )
    kept = F.filter(ranked, lambda x, i: ~inside(x, i))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.regexp_replace(x["text"], r"\.+\z", "").alias("text")))


def errors(text: Column) -> Column:
    """Exact diagnostics, to the end of the line."""
    found = F.transform(tx.matches(text, lx.ERROR_LITERAL), lambda m: F.struct(m["start"].alias("start"), tx.rstrip(m["text"]).alias("text")))
    possible = F.lower(text).rlike(ERROR_HINT)
    return F.when(possible, found).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def _free_atoms(untrusted: Column | None) -> Column:
    """All atoms of a line that is neither labelled nor in a section; starts count from the stripped text.

    Reads the columns body, free_kind and semis, each found once for the line.
    """
    text, kind, semis, role, trusted = (F.col(c) for c in ("body", "free_kind", "semis", "role", "may_state"))
    whole = F.array(atom(F.lit(0), text, kind))
    split = F.filter(
        F.transform(semis, lambda p: atom(p["start"], p["text"], classify(p["text"], role, trusted, untrusted))), lambda a: a["kind"].isNotNull()
    )
    plain = F.when(kind.isNull(), F.array().cast(NONE)).otherwise(whole)
    several = F.size(semis) > 1
    own = (
        F.when(kind == "constraint", F.transform(constraint_clauses(text), lambda p: atom(p["start"], p["text"], F.lit("constraint"))))
        .when(several & (kind == "user_correction"), F.concat(whole, F.filter(split, lambda a: a["kind"] != "user_correction")))
        .when(several & (F.size(split) > 0), split)
        .otherwise(plain)
    )
    second = lambda own: F.filter(
        F.transform(
            F.filter(own, lambda a: (a["kind"] == "user_correction") & in_role(role, lx.COMMITMENT_ROLES)),
            lambda a: atom(a["start"], a["text"], new_value(a["text"]), "correction-derived", "current-value"),
        ),
        lambda a: a["kind"].isNotNull(),
    )
    side = F.when(
        (kind == "discarded_attempt") & in_role(role, lx.COMMITMENT_ROLES),
        F.transform(F.filter(semis, lambda p: tx.like(p["text"], lx.CONSTRAINT)), lambda p: atom(p["start"], p["text"], F.lit("constraint"))),
    ).otherwise(F.array().cast(NONE))
    wrong = F.transform(errors(text), lambda p: atom(p["start"], p["text"], F.lit("exact_error")))
    cited = F.transform(references(text), lambda p: atom(p["start"], p["text"], F.lit("exact_reference")))
    stated = tx.bound(own.cast(NONE), lambda own: F.concat(own, second(own).cast(NONE)))
    return F.concat(stated, side.cast(NONE), wrong.cast(NONE), cited.cast(NONE))


def _once(atoms: Column) -> Column:
    """Atoms without later ones of the same place, kind and length."""
    same = lambda x, y: (x["start"] == y["start"]) & (x["kind"] == y["kind"]) & (x["n"] == y["n"])

    def told(all_: Column) -> Column:
        keys = F.transform(all_, lambda a, k: F.struct(a["start"].alias("start"), a["kind"].alias("kind"), F.length(a["text"]).alias("n"), k.alias("k")))
        first = tx.bound(F.array_sort(keys), lambda s: F.filter(s, lambda x, i: (i == 0) | ~F.coalesce(same(x, F.get(s, i - 1)), F.lit(False))))
        return F.transform(F.array_sort(F.transform(first, lambda x: x["k"])), lambda k: F.get(all_, k))

    return tx.bound(atoms, lambda all_: F.when(F.size(all_) < 2, all_).otherwise(told(all_)))


def _kind_of(label: Column, labels: dict[str, str], strict: bool) -> Column:
    """The kind that a label names, if the record's role may state it."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    kind = F.try_element_at(names, F.lower(tx.strip(F.translate(label, "_", " "))))
    return tx.bound(kind, lambda k: F.when(k.isNotNull() & can_author(k, strict), k))


@remembered
def _section_rows(labels: tuple[tuple[str, str], ...], strict: bool) -> Column:
    """array<struct<line_start, m: struct<line, label_kind, bullet>, section>> of a content's lines."""

    def marked(raw: Column) -> Column:
        line = _ended(raw)
        kind = F.when(F.contains(line, F.lit(":")), _kind_of(F.regexp_extract(line, lx.LABEL_LINE, 2), dict(labels), strict))
        return F.struct(line.alias("line"), kind.alias("label_kind"), F.regexp_extract(line, lx.BULLET, 1).alias("bullet"))

    def step(reach: Column, m: Column, k: Column) -> tuple[Column, Column]:
        return F.when(m["label_kind"].isNotNull(), k).when(m["bullet"] == "", -1).otherwise(reach), F.array(reach)

    def told(raws: Column) -> Column:
        def row(at: Column, marks: Column, reach: Column) -> Column:
            return F.transform(
                marks,
                lambda m, k: F.struct(
                    F.get(at, k).alias("line_start"),
                    m.alias("m"),
                    F.when(m["label_kind"].isNull() & (m["bullet"] != ""), F.get(marks, F.nullif(F.get(reach, k), F.lit(-1)))["label_kind"]).alias("section"),
                ),
            )

        return tx.bound(_starts(raws), lambda at: tx.bound(F.transform(raws, marked), lambda ms: tx.bound(tx.folded(ms, F.lit(-1), step), lambda reach: row(at, ms, reach))))

    return tx.bound(tx.line_array(F.coalesce("content", F.lit(""))), told)


def sections(records: DataFrame, labels: dict[str, str], strict: bool) -> DataFrame:
    """One row per line with its label, bullet and the section that reaches it.

    A section reaches the bullets after its label line; any other line ends it.
    """
    own = unnest(records, KEEP, _section_rows(tuple(labels.items()), strict), "l", "pos")
    rows = own.select(*KEEP, "pos", "l.line_start", F.col("l.m.line").alias("line"), F.col("l.m.label_kind").alias("label_kind"), F.col("l.section").alias("section"), F.col("l.m.bullet").alias("_bullet"))
    label = [F.regexp_extract("line", lx.LABEL_LINE, k) for k in range(1, 5)]
    named = F.col("label_kind").isNotNull()
    return rows.withColumns(
        {
            "value": F.when(named, label[3]).otherwise(F.regexp_extract("line", lx.BULLET, 2)),
            "value_start": F.when(named, sum([F.length(c) for c in label[:3]], F.lit(0))).otherwise(F.length("_bullet")),
        }
    ).drop("_bullet")


def _stated(start: Column, value: Column, kind: Column, tag: Column) -> Column:
    """Atoms of a labelled value or a bullet; a second bullet sign is not part of the value."""
    inner = tx.strip(value)
    sign = F.regexp_extract(inner, lx.BULLET, 1)
    clean = tx.strip(F.substring(inner, F.length(sign) + 1, F.length(inner)))
    first = start + F.length(value) - F.length(tx.lstrip(value)) + F.length(sign)
    whole = F.array(F.struct(F.lit(0).alias("start"), clean.alias("text")))
    parts = F.when(kind == "constraint", constraint_clauses(clean)).otherwise(whole)
    return F.when(clean == "", F.array().cast(NONE)).otherwise(
        F.transform(
            parts,
            lambda p: F.struct(
                (first + p["start"]).cast("int").alias("start"), p["text"].alias("text"), kind.alias("kind"), tag.alias("tags"), kind.isin(lx.EXACT).alias("exact")
            ),
        ).cast(NONE)
    )


@remembered
def _item_columns(extractor: str) -> list[Column | str]:
    start = F.col("line_start") + F.col("a.start")
    priority = F.element_at(F.create_map(*[F.lit(x) for k, v in lx.KINDS.items() for x in (k, v)]), F.col("a.kind"))
    priority = F.least(F.lit(100), priority + F.when(F.col("role") == "user", lx.USER_BONUS).otherwise(0))
    end = start + F.length("a.text")
    span = F.struct(F.col("source_id"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.col("a.text").alias("quote"))
    none = F.array().cast("array<string>")
    return [
        "history_id",
        F.concat(F.lit("m-"), F.left(tx.hash_of(F.col("a.kind"), F.lower("a.text"), F.col("source_id"), start, end), F.lit(24))).alias("id"),
        F.col("a.kind").alias("kind"),
        F.col("a.text").alias("text"),
        F.lit("active").alias("status"),
        priority.cast("int").alias("priority"),
        F.lit(1.0).alias("confidence"),
        F.col("a.exact").alias("exact"),
        F.col("a.tags").alias("tags"),
        none.alias("supersedes"),
        none.alias("conflicts_with"),
        F.array(span).alias("provenance"),
        "sequence",
        F.array(F.lower("role")).alias("roles"),
        F.array(F.lit(extractor)).alias("extractors"),
    ]


def items_of(rows: DataFrame, atoms: Column, extractor: str) -> DataFrame:
    """Items from an array of atoms whose starts count from the line."""
    one = unnest(rows, ["history_id", "source_id", "sequence", "role", "line_start"], atoms, "a")
    return one.select(*_item_columns(extractor))


DEFAULT_LABELS = {label: kind for kind, names in lx.LABELS.items() for label in names}


@remembered
def _rules(strict: bool) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column], Column]:
    """What is known of a line, what it is judged to be, the atoms found in it, and those atoms placed in the line."""
    trusted = in_role(F.col("role"), lx.STATE_ROLES) | F.col("trusted")
    untrusted = F.col("untrusted") if strict else None
    stated_kind = F.coalesce("label_kind", "section")
    known = {"body": tx.strip(F.col("line")), "stated_kind": stated_kind, "may_state": trusted & ~untrusted if strict else trusted}
    free = F.col("stated_kind").isNull()
    judged = {
        "free_kind": F.when(free, classify(F.col("body"), F.col("role"), F.col("may_state"), untrusted)),
        "semis": F.when(free & F.contains("body", F.lit(";")), semicolon_clauses(F.col("body"))).when(
            free, F.array(F.struct(F.lit(0).alias("start"), F.col("body").alias("text")))
        ),
    }
    tag = F.when(F.col("label_kind") == "user_correction", F.array(F.lit("explicit-correction-label"))).otherwise(F.array().cast("array<string>"))
    stated = _stated(F.col("value_start"), F.col("value"), F.col("stated_kind"), tag)
    lead = F.length("line") - F.length(tx.lstrip(F.col("line")))
    found = {"lead": lead, "found": F.when(free, _free_atoms(untrusted)).otherwise(stated)}
    moved = F.transform(
        "found",
        lambda a: F.struct((a["start"] + F.when(free, F.col("lead")).otherwise(0)).cast("int").alias("start"), a["text"].alias("text"), a["kind"].alias("kind"), a["tags"].alias("tags"), a["exact"].alias("exact")),
    )
    return known, judged, found, _once(moved)


def extract(records: DataFrame, protected_only: bool = False, strict: bool = False) -> DataFrame:
    """Items of all records by the rules.

    Null content counts as empty. strict holds back state claims of records marked untrusted.
    protected_only keeps the kinds that a ledger may never lose (P3).
    """
    rows = sections(records, DEFAULT_LABELS, strict)
    known, judged, found, atoms = _rules(strict)
    rows = rows.withColumns(known).where("body <> ''").withColumns(judged).withColumns(found)
    out = items_of(rows, atoms, "rules")
    return out.where(F.col("kind").isin(lx.PROTECTED)) if protected_only else out


def extract_labels(records: DataFrame, labels: dict[str, str], name: str = "domain-labels", strict: bool = False) -> DataFrame:
    """G14, UD7: items of a caller's own labels; at most 256, each of letters, digits, spaces, _ and -."""
    import re

    folded = {}
    for label, kind in labels.items():
        key = " ".join(label.strip().replace("_", " ").split()).casefold()
        if not re.fullmatch(r"[a-z][a-z0-9 -]{0,127}", key) or kind not in lx.KINDS or key in folded:
            raise ValueError(f"label {label!r}")
        folded[key] = kind
    if not 1 <= len(folded) <= 256:
        raise ValueError("1 to 256 labels are allowed")
    rows = sections(records, folded, strict)
    kind = F.coalesce("label_kind", "section")
    tag = F.when(kind == "user_correction", F.array(F.lit("explicit-correction-label"))).otherwise(F.array().cast("array<string>"))
    atoms = _stated(F.col("value_start"), F.col("value"), kind, tag)
    return items_of(rows.where(kind.isNotNull()).withColumn("_atoms", atoms), _once(F.col("_atoms")), name)


def locate_literals(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates (history_id, source_id, kind, text) with the place of a text that occurs exactly once.

    reason is null for a located one, else missing, repeated or source.
    """
    own = records.select("history_id", "source_id", "content")
    joined = candidates.join(own, ["history_id", "source_id"], "left")
    start = F.expr("locate(text, content)")
    again = F.expr("locate(text, content, locate(text, content) + 1)")
    reason = (
        F.when(F.col("content").isNull(), "source").when((F.col("text") == "") | (start == 0), "missing").when(again > 0, "repeated")
    )
    return joined.select(
        *candidates.columns,
        F.when(reason.isNull(), start - 1).cast("int").alias("start"),
        F.when(reason.isNull(), start - 1 + F.length("text")).cast("int").alias("end"),
        reason.alias("reason"),
    )
