"""Queries on limits, plug-ins, bundles, checkpoints, evaluation rows and small functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tables import settle
from ..operators import archive, bundle, evaluate, extract, limits, report, select
from ..operators.resolve import COLUMNS
from ..sources import derived
from . import faults
from . import checked  # noqa: F401  registers selection_order
from .queries import SQL, order_items, query, table

K = faults.K
U = "'u' || CAST(c_custkey AS VARCHAR)"


def customers(spark, sf_dir):
    """Customers, each a history of one record that is its name."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("history_id"), F.lit("s0").alias("source_id"), F.lit(0).cast("bigint").alias("sequence"),
        F.lit("user").alias("role"), F.col("c_name").alias("content"), F.col("c_custkey").alias("n"),
    )


# ---- limits and plug-ins ----

_LOAD = f"""
SELECT history_id, CAST(sum(n) AS BIGINT) AS items, CAST(sum(n) AS BIGINT) AS spans, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS comparisons
FROM (SELECT history_id, kind, count(*) AS n, sum(length(text)) AS b FROM ({derived.EXPECTED}) e GROUP BY history_id, kind) k GROUP BY history_id
"""
TIGHT = limits.Limits(max_items=12, max_spans=14, max_bytes=400, max_comparisons=20)


@query(_LOAD)
def workloads(spark, sf_dir):
    """2.16: what each history would cost to resolve, before anything is compared."""
    return limits.workload(order_items(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT history_id, '{n}' AS \"limit\" FROM ({_LOAD}) w WHERE {n} > {getattr(TIGHT, 'max_' + n)}" for n in ("items", "spans", "bytes", "comparisons")))
def limit_breaches(spark, sf_dir):
    """2.16: every limit that a history exceeds."""
    return limits.exceeded(order_items(spark, sf_dir), TIGHT)


@query(f"""
SELECT r.history_id, r.source_id, CAST(r.sequence AS BIGINT) AS sequence,
       CAST(12 - coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY r.history_id ORDER BY r.sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS allowance
FROM ({derived.RECORDS}) r LEFT JOIN (SELECT history_id, source_id, count(*) AS n FROM ({derived.EXPECTED}) e GROUP BY history_id, source_id) g ON r.history_id = g.history_id AND r.source_id = g.source_id
""")
def item_allowances(spark, sf_dir):
    """How many items each record may still give."""
    rows = derived.records(spark, sf_dir)
    return limits.allowance(extract.extract(rows), rows, TIGHT)


@query(f"SELECT history_id, kind, text, source_id AS source_ids FROM ({derived.EXPECTED}) e")
def claims_without_places(spark, sf_dir):
    """Claims with the ids of their records and no offsets."""
    return limits.without_places(order_items(spark, sf_dir)).withColumn("source_ids", F.array_join("source_ids", ","))


def _plugin(spark, sf_dir):
    """Items as a plug-in gives them, one per customer, each with the fault that its number names."""
    n = F.col("n") % 9
    text = F.col("content")
    say = lambda s, a, b, q: F.array(F.struct(s.alias("source_id"), a.cast("int").alias("start"), b.cast("int").alias("end"), q.alias("quote")))
    none = F.array().cast("array<string>")
    span = F.when(n == 6, F.array().cast("array<struct<source_id:string,start:int,end:int,quote:string>>")).otherwise(
        say(F.when(n == 5, F.lit("s9")).otherwise(F.lit("s0")), F.lit(0), F.length(text) + F.when(n == 7, 1).otherwise(0), F.when(n == 8, F.concat(text, F.lit("!"))).otherwise(text))
    )
    own = {
        "id": F.lit("x"), "kind": F.when(n == 1, F.lit("wish")).otherwise(F.lit("progress")), "text": F.when(n == 2, F.lit(" ")).otherwise(text), "status": F.lit("active"),
        "priority": F.when(n == 3, 101).otherwise(45), "confidence": F.lit(1.0), "exact": F.lit(False), "tags": F.when(n == 4, F.array(F.lit("current-value"))).otherwise(none),
        "supersedes": none, "conflicts_with": none, "provenance": span, "roles": F.array(F.lit("user")), "extractors": F.array(F.lit("own")),
    }
    return customers(spark, sf_dir).select("*", *[c.alias(n) for n, c in own.items()]).select(*COLUMNS)


@query(f"""
SELECT {U} AS history_id, 'x' AS id, reason FROM customer, (VALUES (1, 'kind'), (2, 'text'), (3, 'range'), (4, 'tag'), (5, 'span'), (6, 'span'), (7, 'span'), (8, 'quote')) v(fault, reason) WHERE c_custkey % 9 = fault
""")
def plugin_rejections(spark, sf_dir):
    """UD2: a plug-in's items that may not count, with the reasons."""
    return limits.rejected(_plugin(spark, sf_dir), customers(spark, sf_dir).drop("n"))


@query(f"""
SELECT {U} AS history_id, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'y' END AS id, 'own' AS extractor FROM customer
UNION ALL SELECT {U}, 'x', 'safety' FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 2 = 1
""")
def additive_items(spark, sf_dir):
    """UD1: a safety extractor's sound items join the built-in ones and replace none."""
    extra = settle(_plugin(spark, sf_dir))
    key = F.substring("history_id", 2, 20).cast("bigint")
    built = extra.withColumn("id", F.when(key % 2 == 0, F.lit("x")).otherwise(F.lit("y")))
    out = limits.additive(built, extra, customers(spark, sf_dir).drop("n"), "safety")
    return out.select("history_id", "id", F.get("extractors", F.lit(0)).alias("extractor"))


@query(SQL["selection_order"])
def counted_selection(spark, sf_dir):
    """UD4: the choice by a caller's own token counter, which counts whole prompts."""
    items = settle(faults.ledger(spark, sf_dir))
    chosen = limits.select_counted(items, faults.records(spark, sf_dir), lambda text: max(1, -(-len(text) // 4)), "chars/4", faults.POLICY)
    rows = chosen.select("history_id", F.posexplode("selected").alias("place", "id"))
    return rows.join(items.select("history_id", "id", "kind", "text"), ["history_id", "id"]).select("history_id", "place", "kind", "text")


# ---- bundles, checkpoints, events ----


@query(f"""
SELECT {U} AS history_id, 'r' || c_custkey AS request_id, code FROM customer, (VALUES (1, 'bundle_digest_mismatch'), (1, 'policy_binding_mismatch'), (2, 'unrequested'), (3, 'source_digest_binding_mismatch'),
  (4, 'artifact_sha256_binding_mismatch'), (5, 'archive_head_binding_mismatch'), (6, 'counter_id_binding_mismatch')) v(fault, code) WHERE c_custkey % 7 = fault
""")
def bundle_bindings(spark, sf_dir):
    """What bundles bind, against changed policies, requests, records, artifacts, heads and counters."""
    rows = customers(spark, sf_dir)
    records, n = rows.drop("n"), F.substring("history_id", 2, 20).cast("bigint") % 7
    requests = rows.select("history_id", F.concat(F.lit("r"), F.col("n").cast("string")).alias("request_id"), F.lit("chars/4").alias("counter_id"), F.lit("p1").alias("policy"))
    artifacts = rows.select("history_id", F.col("content").alias("artifact"))
    heads = rows.select("history_id", F.md5("content").alias("head"))
    made = settle(bundle.bind(requests, records, artifacts, heads))
    bent = made.withColumn("policy", F.when(n == 1, F.lit("p2")).otherwise(F.col("policy")))
    other = lambda df, fault, c: df.withColumn(c, F.when(n == fault, F.concat(c, F.lit("!"))).otherwise(F.col(c)))
    asked = other(requests, 6, "counter_id").where(n != 2)
    return bundle.binding_issues(bent, asked, other(records, 3, "content"), other(artifacts, 4, "artifact"), other(heads, 5, "head"))


@query(f"""
SELECT {U} AS history_id, code FROM customer, (VALUES (1, 'verification_disabled'), (2, 'missing_artifact_policy'), (2, 'primary_failure_policy_mismatch'), (3, 'policy_mismatch'), (4, 'primary_failure_policy_mismatch'),
  (5, 'impossible_overflow_policy'), (6, 'impossible_recovery_policy'), (7, 'policy_mismatch'), (7, 'policy_mismatch')) v(fault, code) WHERE c_custkey % 8 = fault
""")
def policy_contradictions(spark, sf_dir):
    """C4: hosts' policies that contradict what artifacts say."""
    rows = table(spark, sf_dir, "customer")
    n, key = F.col("c_custkey") % 8, F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("history_id")
    repeated = {"token_budget": F.lit(4000), "minimum_ratio": F.lit(5.0), "chars_per_token": F.lit(4.0), "include_superseded": F.lit(False), "include_discarded": F.lit(False)}
    own = [key, *[c.alias(k) for k, c in repeated.items()]]
    said = {"token_budget": F.when(n.isin(3, 7), 100).otherwise(4000), "chars_per_token": F.when(n == 7, 3.0).otherwise(4.0)}
    policies = rows.select(
        key, *[said.get(k, c).alias(k) for k, c in repeated.items()], (n != 1).alias("verify"), F.lit(True).alias("fail_on_primary_error"), F.lit(True).alias("fail_on_overflow"), F.lit(False).alias("recover_missed")
    )
    artifacts = rows.where(n != 2).select(*own, (n != 4).alias("fail_on_primary_error"), F.when(n == 5, 9).otherwise(0).alias("overflow"), F.when(n == 6, 2).otherwise(0).alias("recovered"))
    return bundle.policy_issues(policies, artifacts)


@query(f"""
SELECT {U} AS history_id, code FROM customer, (VALUES (1, 'checkpoint_digest_mismatch'), (1, 'source_count_mismatch'), (2, 'source_digest_mismatch'), (2, 'fork'), (3, 'rollback'), (4, 'fork')) v(fault, code) WHERE c_custkey % 6 = fault
""")
def checkpoint_refusals(spark, sf_dir):
    """S12, ST3: checkpoints that were altered, and those that a live session must not go back or over to."""
    records = customers(spark, sf_dir).drop("n")
    n = F.substring("history_id", 2, 20).cast("bigint") % 6
    rows, state = bundle.checkpoint(records)
    rows = rows.withColumn("content", F.when(n == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    state = state.withColumn("source_count", F.when(n == 1, F.col("source_count") + 1).otherwise(F.col("source_count")))
    more = records.where(n == 3).withColumns({"source_id": F.lit("s1"), "sequence": F.lit(1).cast("bigint")})
    live = records.withColumn("content", F.when(n == 4, F.concat("content", F.lit("?"))).otherwise(F.col("content"))).unionByName(more)
    return bundle.resume_issues(rows, state, live)


@query(f"SELECT {U} AS history_id, md5(c_name) AS source_digest, c_custkey AS source_count FROM customer WHERE c_custkey % 6 = 0")
def manifests_reread(spark, sf_dir):
    """Manifests as texts, read back; cut off, with another field, nested, too long or without a digest they are none."""
    n = F.col("source_count") % 6
    made = customers(spark, sf_dir).select(
        "history_id", F.md5("content").alias("source_digest"), F.col("n").alias("source_count"), F.lit("a").alias("artifact_digest"), F.lit(None).cast("string").alias("archive_head"), F.lit("m").alias("manifest_sha256")
    )
    made = made.withColumn("source_digest", F.when(n != 5, F.col("source_digest")))
    key = F.substring("history_id", 2, 20).cast("bigint") % 6
    text = F.col("text")
    more = lambda extra: F.concat(F.expr("left(text, length(text) - 1)"), extra, F.lit("}"))
    bent = (
        F.when(key == 1, F.expr("left(text, length(text) - 1)")).when(key == 2, more(F.lit(',"own":1'))).when(key == 3, F.replace(text, F.lit('"a"'), F.lit("[" * 9 + "]" * 9)))
        .when(key == 4, F.replace(text, F.lit('"a"'), F.concat(F.lit('"'), F.repeat(F.lit("a"), 70_000), F.lit('"')))).otherwise(text)
    )
    return report.load_manifests(report.manifest_text(made).select(bent.alias("text"))).where("readable").select("history_id", "source_digest", "source_count")


@query(f"SELECT 'p' || {K} AS history_id, p_partkey % 7 <> 0 AS passed, CAST(15 AS BIGINT) AS n_items, CAST(2 AS BIGINT) AS n_conflicting, 13 AS n_selected FROM part")
def compile_events(spark, sf_dir):
    """K7: one log row for each history."""
    items = settle(faults.ledger(spark, sf_dir))
    summary = items.select("history_id").distinct().withColumn("passed", F.substring("history_id", 2, 20).cast("bigint") % 7 != 0)
    wide = items.groupBy("history_id").agg(F.lit(1_000_000).cast("bigint").alias("n_chars"))
    return bundle.event(items, select.select(items, wide, faults.POLICY), summary).select("history_id", "passed", "n_items", "n_conflicting", "n_selected")


@query("""
SELECT 'v' || conv_id AS history_id, count(*) AS n_entries, CAST(0 AS BIGINT) AS n_issues FROM conversations GROUP BY conv_id
""")
def archive_upgrade(spark, sf_dir):
    """A3: legacy histories of an archive are chained, chained ones stay, and all verify."""
    whole = archive.archived(derived.conversations(spark, sf_dir))
    legacy = F.substring("history_id", 2, 20).cast("bigint") % 2 == 0
    kept = settle(whole.withColumns({c: F.when(~legacy, F.col(c)) for c in ("position", "previous", "entry")}))
    now = settle(archive.upgrade(kept))
    wrong = archive.verify(now).groupBy("history_id").agg(F.count("*").alias("n_issues"))
    out = now.groupBy("history_id").agg(F.count("entry").alias("n_entries")).join(wrong, "history_id", "left")
    return out.select("history_id", "n_entries", F.coalesce("n_issues", F.lit(0).cast("bigint")).alias("n_issues"))


# ---- evaluation ----


def _gold(spark, sf_dir):
    """Parts as histories: the gold atom is the name; every third claim has another span, every fifth is missing; of each seventh the prompt denies it."""
    key, text = F.col("p_partkey"), F.col("p_name")
    gold = table(spark, sf_dir, "part").select(
        key.alias("n"), F.concat(F.lit("p"), key.cast("string")).alias("history_id"), F.lit("a").alias("atom_id"), F.lit("progress").alias("kind"), text.alias("text"), F.lit("s0").alias("source_id"),
        F.lit(0).alias("start"), F.length(text).alias("end"), (key % 2 == 0).alias("exact"),
    )
    wide = F.col("n") % 3 == 0
    span = F.struct("source_id", "start", (F.col("end") + F.when(wide, 4).otherwise(0)).alias("end"), F.concat(F.col("text"), F.when(wide, F.lit(" and")).otherwise(F.lit(""))).alias("quote"))
    claims = gold.where("n % 5 <> 0").select("history_id", F.lit("x").alias("id"), "kind", "text", F.array(span).alias("provenance"))
    prompts = gold.select("history_id", F.concat(F.when(F.col("n") % 7 == 0, F.lit("it is not ")).otherwise(F.lit("it is ")), F.col("text")).alias("prompt"))
    return gold, claims, prompts


@query("""
SELECT 'p' || p_partkey AS history_id, CAST(1 AS BIGINT) AS atoms, CAST(hit AS BIGINT) AS hits, CAST(1 - p_partkey % 2 AS BIGINT) AS exact_atoms, CAST(CASE WHEN p_partkey % 2 = 0 THEN hit ELSE 0 END AS BIGINT) AS exact_hits,
       CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS BIGINT) AS rendered, CAST(made AS BIGINT) AS claims, CAST(hit AS BIGINT) AS tight, CAST(hit AS DOUBLE) AS recall,
       CASE WHEN p_partkey % 2 = 1 THEN 1.0::DOUBLE ELSE CAST(hit AS DOUBLE) END AS exact_recall, CASE WHEN made = 0 THEN 1.0::DOUBLE ELSE CAST(hit AS DOUBLE) END AS "precision", CASE WHEN made = 0 THEN 1.0::DOUBLE ELSE CAST(hit AS DOUBLE) END AS tight_share
FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS made, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 0 THEN 0 ELSE 1 END AS hit FROM part) x
""")
def history_scores(spark, sf_dir):
    """Each history's atoms, hits, tight claims and atoms that its prompt states."""
    return evaluate.history_metrics(*_gold(spark, sf_dir))


@query("""
SELECT 'p' || p_partkey AS history_id, 'x' AS id FROM part WHERE p_partkey % 5 <> 0 AND (p_partkey % 4 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0)
""")
def authority_violations(spark, sf_dir):
    """Claims on spans that may state nothing, of untrusted roles, or of no record."""
    gold, claims, _ = _gold(spark, sf_dir)
    n = F.col("n")
    records = gold.where(n % 13 != 0).select("history_id", "source_id", F.when(n % 11 == 0, F.lit("tool")).otherwise(F.lit("User")).alias("role"))
    negatives = gold.where(n % 4 == 0).select("history_id", "source_id", (F.col("end") - 1).alias("start"), (F.col("end") + 300).alias("end"), F.col("atom_id").alias("id"))
    return evaluate.authority_violations(claims, records, negatives, ["progress"], ["user"])


_CASE = "o_totalprice AS a, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice + (o_orderkey % 5 - 2) * 10 END AS b, o_orderkey % 6 <> 0 AS valid"


@query(f"""
SELECT o_orderpriority AS "group", count(*) FILTER (ok AND a - b > 1) AS wins, count(*) FILTER (ok AND abs(a - b) <= 1) AS ties, count(*) FILTER (ok AND a - b < -1) AS losses, count(*) FILTER (NOT ok) AS invalid,
       count(*) FILTER (ok AND a - b > 1) * 2 > count(*) AS ahead
FROM (SELECT *, valid AND b IS NOT NULL AS ok FROM (SELECT o_orderpriority, {_CASE} FROM orders) x) y GROUP BY o_orderpriority
""")
def system_comparison(spark, sf_dir):
    """E5: wins, ties, losses and invalid cases of two systems."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("group"), *[F.expr(e) for e in _CASE.split(", ")])
    return evaluate.compare_systems(cases, margin=1.0)


@query("""
SELECT p_partkey, trim(CASE WHEN p_size % 10 = 0 THEN 'unknown ' ELSE CASE WHEN p_size > 20 THEN '' ELSE 'recall ' END END || CASE WHEN p_retailprice < 1500 THEN '' ELSE 'latency' END) AS failed,
       p_size % 10 <> 0 AND p_size > 20 AND p_retailprice < 1500 AS certified FROM part
""")
def certificate_gates(spark, sf_dir):
    """Gates that rows fail; a gate that cannot be decided fails."""
    size = F.col("p_size")
    rules = {"recall": F.when(size % 10 == 0, True).otherwise(size > 20), "unknown": F.when(size % 10 != 0, True), "latency": F.col("p_retailprice") < 1500}
    out = evaluate.gates(table(spark, sf_dir, "part"), ["p_partkey"], rules)
    return out.withColumn("failed", F.array_join("failed", " "))


# ---- small functions ----


@query("""
SELECT p_partkey, p_partkey % 9 + 1 AS depth, p_partkey % 4 = 3 AS long FROM part
""")
def json_shapes(spark, sf_dir):
    """Depth of JSON texts and integers that are too long, brackets and digits in strings aside."""
    n = F.col("p_partkey")
    digits = F.when(n % 4 == 3, F.repeat(F.lit("7"), 12)).when(n % 4 == 2, F.concat(F.repeat(F.lit("7"), 12), F.lit(".5"))).otherwise(F.repeat(F.lit("7"), 9))
    word = F.concat(F.lit('"[[{\\\\\\"[[ 777777777777777 '), F.col("p_name"), F.lit('"'))
    text = F.concat(F.expr("repeat('[', cast(p_partkey % 9 as int))"), F.lit('{"a":'), word, F.lit(',"b":'), digits, F.lit("}"), F.expr("repeat(']', cast(p_partkey % 9 as int))"))
    return table(spark, sf_dir, "part").select("p_partkey", (tx.json_depth(text)).cast("bigint").alias("depth"), tx.has_long_integer(text, 10).alias("long"))


@query("""
SELECT o_orderkey, o_orderkey % 6 IN (0, 1) AS is_time FROM orders
""")
def utc_times(spark, sf_dir):
    """Times in UTC by their syntax: another zone, an hour 24, a day that is not, or a blank between are none."""
    day, n = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 6
    text = (
        F.when(n == 0, F.concat(day, F.lit("T10:20:30Z"))).when(n == 1, F.concat(day, F.lit("T10:20:30.125+00:00"))).when(n == 2, F.concat(day, F.lit("T10:20:30+02:00")))
        .when(n == 3, F.concat(day, F.lit("T24:00:00Z"))).when(n == 4, F.concat(F.left(day, F.lit(5)), F.lit("02-30T10:20:30Z"))).otherwise(F.concat(day, F.lit(" 10:20:30Z")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.is_utc_time(text).alias("is_time"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'missing:name' ELSE 'unknown:extra' END AS faults, CASE n_nationkey % 3 WHEN 1 THEN 0 ELSE 1 END AS n_left FROM nation
""")
def object_keys(spark, sf_dir):
    """U6 and map functions: keys that are missing or unknown, and objects without some keys."""
    n = F.col("n_nationkey") % 3
    one = lambda k: F.create_map(F.lit(k), F.col("n_name"))
    none = F.create_map().cast("map<string,string>")
    given = F.map_concat(one("id"), F.when(n != 1, one("name")).otherwise(none), F.when(n == 2, one("extra")).otherwise(none))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(tx.key_faults(given, ["id", "name"]), ",").alias("faults"), F.size(tx.without_keys(given, ["id", "extra"])).alias("n_left"))
