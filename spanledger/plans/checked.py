"""More queries with their SQL: known ledgers, seeded faults, redaction, archives, reports, decoding, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.tables import settle, shared_dir
from ..operators import archive, artifact, evaluate, extract, plugins, redact, report, resolve, select
from ..sources import derived
from ..sources import records as source
from . import faults
from .compile import recover, source_chars
from .queries import named_items, packed, query, table

K = faults.K

# ---- known ledgers ----


@query(faults.EXPECTED)
def ledger_states(spark, sf_dir):
    """R1-R10, AG1, J3-J5: every item of every ledger with its status, tags and links."""
    return faults.ledger(spark, sf_dir).select(
        "history_id", "sequence", "kind", "text", "status", F.array_join("tags", ",").alias("tags"), F.size("supersedes").alias("n_supersedes"), F.size("conflicts_with").alias("n_conflicts")
    )


@query(f"""
SELECT 'p' || {K} AS history_id, 'Actually, the label count must be exactly 7 instead' AS correction, 'the label count must be exactly 5' AS prior,
       'Actually, the label count must be exactly 7 instead' AS heir FROM part
""")
def correction_pairs(spark, sf_dir):
    """Which item each correction replaces, and which stands for it."""
    items = settle(resolve.canonicalize(extract.extract(faults.records(spark, sf_dir))))
    text = lambda n, c: items.select("history_id", F.col("id").alias(n), F.col("text").alias(c))
    links = resolve.correction_links(items).where("verdict = 'clear'").select("history_id", "own", "prior", "heir")
    out = links.join(text("own", "correction"), ["history_id", "own"]).join(text("prior", "prior_text"), ["history_id", "prior"]).join(text("heir", "heir_text"), ["history_id", "heir"])
    return out.select("history_id", "correction", F.col("prior_text").alias("prior"), F.col("heir_text").alias("heir"))


@query(f"SELECT 'p' || {K} AS history_id, 'Is the weight of crate ' || {K} || ' known?' AS question, 'confirmed: the weight of crate ' || {K} || ' is verified' AS answer FROM part")
def question_closure(spark, sf_dir):
    """Which question each confirmation closes."""
    items = settle(resolve.canonicalize(extract.extract(faults.records(spark, sf_dir))))
    text = lambda n, c: items.select("history_id", F.col("id").alias(n), F.col("text").alias(c))
    links = resolve.closing_links(items)
    return links.join(text("own", "answer"), ["history_id", "own"]).join(text("prior", "question"), ["history_id", "prior"]).select("history_id", "question", "answer")


_PROTECTED = "(kind IN ('goal', 'constraint', 'user_correction', 'unresolved', 'exact_error', 'exact_reference') OR tags LIKE '%resolves-protected%')"


@query(f"""
SELECT history_id, CAST(row_number() OVER (PARTITION BY history_id ORDER BY CASE WHEN {_PROTECTED} THEN 0 ELSE 1 END, CASE WHEN {_PROTECTED} THEN kind END, CASE kind WHEN 'decision' THEN 0 ELSE 1 END, sequence) - 1 AS INT) AS place, kind, text
FROM ({faults.EXPECTED}) e WHERE status <> 'superseded'
""")
def selection_order(spark, sf_dir):
    """What is chosen, protected items first, in order."""
    rows = faults.records(spark, sf_dir)
    items = settle(faults.ledger(spark, sf_dir))
    chosen = select.select(items, source_chars(rows), faults.POLICY).select("history_id", F.posexplode("selected").alias("place", "id"))
    return chosen.join(items.select("history_id", "id", "kind", "text"), ["history_id", "id"]).select("history_id", "place", "kind", "text")


@query(f"""
SELECT history_id, count(*) AS items, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'discarded') AS discarded, count(*) FILTER (status = 'conflicting') AS conflicting,
       count(*) FILTER (status = 'superseded') AS superseded, count(*) FILTER ({_PROTECTED}) AS protected, count(*) FILTER (kind LIKE 'exact%') AS exact, count(*) + 1 AS spans,
       count(*) FILTER (tags LIKE '%correction-derived%') AS correction_derived, count(*) FILTER (tags LIKE '%detected-conflict%') AS detected_conflict, count(*) FILTER (tags LIKE '%resolves-protected%') AS resolves_protected,
       CAST(0 AS BIGINT) AS ambiguous_supersession, CAST(0 AS BIGINT) AS additive_clarification
FROM ({faults.EXPECTED}) e GROUP BY history_id
""")
def ledger_counters(spark, sf_dir):
    """AG3: all counters of every ledger."""
    return report.metrics(faults.ledger(spark, sf_dir))


@query(f"""
SELECT 'p' || {K} AS history_id, CASE WHEN p_partkey % 33 = 30 THEN 0 ELSE 1 END AS goals, CASE WHEN p_partkey % 33 = 4 THEN 6 ELSE 5 END AS constraints, 1 AS corrections, 1 AS facts, 1 AS decisions,
       1 AS open_questions, 1 AS errors, 1 AS "references", CASE WHEN p_partkey % 33 = 30 THEN 1 ELSE 0 END AS omitted_protected FROM part
""")
def memory_sections(spark, sf_dir):
    """Memory by category, and protected items left out."""
    items = settle(faults.ledger(spark, sf_dir))
    chosen = faults.bent_selection(select.select(items, source_chars(faults.records(spark, sf_dir)), faults.POLICY), items)
    told = report.sections(items, chosen)
    return told.select("history_id", *[F.size(c).alias(c) for c in told.columns if c != "history_id"])


# ---- verification ----


@query(faults.ISSUES)
def verified_faults(spark, sf_dir):
    """Everything reported of ledgers with one seeded fault each, false alarms included."""
    return faults.issues(spark, sf_dir).select("history_id", faults.fault().cast("int").alias("fault"), "code", "severity")


@query(f"""
SELECT 'p' || {K} AS history_id, text FROM part, (VALUES ('the belt must be closed'), ('the label count must be exactly 5'), ('Actually, the label count must be exactly 7 instead'),
  ('The vent must be enabled'), ('The vent must be disabled')) v(text) UNION ALL SELECT 'p' || {K}, 'Never ship crate ' || {K} || ' open' FROM part
""")
def recovered_items(spark, sf_dir):
    """What a primary extractor missed joins its items."""
    found = settle(extract.extract(faults.records(spark, sf_dir)))
    whole = recover(found.where("kind <> 'constraint'"), found)
    return whole.where(F.array_contains("tags", "verifier-recovered")).select("history_id", "text")


@query(f"""
SELECT 'p' || {K} AS history_id, p_partkey % 7 <> 0 AS passed, CAST(9 AS BIGINT) AS detected, CAST(CASE WHEN p_partkey % 3 = 0 THEN 8 ELSE 9 END AS BIGINT) AS retained,
       CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lost, p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 AS issued FROM part
""")
def retention_certificates(spark, sf_dir):
    """Issued where a history passes and loses nothing; a claim kept twice hides no loss."""
    found = settle(extract.extract(faults.records(spark, sf_dir)))
    key = F.substring("history_id", 2, 20).cast("bigint")
    wanted = found.where(F.col("kind").isin("goal", "constraint", "exact_error", "exact_reference"))
    kept = wanted.where((key % 3 != 0) | (F.col("kind") != "goal")).unionByName(wanted.where("kind = 'exact_error'"))
    summary = wanted.select("history_id").distinct().withColumn("passed", key % 7 != 0)
    return report.certificate(wanted, kept, summary)


# ---- redaction ----

_MD5 = "md5(CAST(c_custkey AS STRING))"
_SECRETS = {
    "openai_style_key": ("'key '", f"'sk-proj-' || {_MD5}", "' end'"),
    "github_token": ("'token '", f"'ghp_' || {_MD5}", "' end'"),
    "aws_access_key_id": ("'id '", f"'AKIA' || upper(substr({_MD5}, 1, 16))", "' end'"),
    "jwt": ("'jwt '", f"'eyJ' || {_MD5} || '.' || {_MD5} || '.' || {_MD5}", "' end'"),
    "bearer_token": ("'Bearer '", _MD5, "' end'"),
    "basic_authorization": ("'Basic '", f"{_MD5} || '=='", "' end'"),
    "url_userinfo": ("'see https://'", f"'u:' || {_MD5}", "'@host/x'"),
    "credential_assignment": ("'password = '''", _MD5, "''' end'"),
    "pem_private_key": ("'pem '", f"'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || {_MD5} || chr(10) || '-----END RSA PRIVATE KEY-----'", "' end'"),
    # An assignment's value that is a key as well: of two equal spans the first detector's counts.
    "openai_style_key ": ("'api_key='", f"'sk-' || {_MD5}", "' end'"),
}
_PART = lambda i: "CASE c_custkey % 10 " + " ".join(f"WHEN {n} THEN {x[i]}" for n, x in enumerate(_SECRETS.values())) + " END"
_DETECTOR = "CASE c_custkey % 10 " + " ".join(f"WHEN {n} THEN '{x.strip()}'" for n, x in enumerate(_SECRETS)) + " END"
_LETTERS = f"SELECT 'u' || CAST(c_custkey AS STRING) AS history_id, 's0' AS source_id, CAST(0 AS BIGINT) AS sequence, 'user' AS role, c_name || ' ' || {_PART(0)} || {_PART(1)} || {_PART(2)} AS content FROM customer"


@query(f"""
SELECT 'u' || CAST(c_custkey AS STRING) AS history_id, CAST(length(c_name || ' ' || {_PART(0)}) AS INT) AS start, CAST(length(c_name || ' ' || {_PART(0)} || {_PART(1)}) AS INT) AS "end", {_DETECTOR} AS detector,
       CAST(length({_PART(1)}) - CASE c_custkey % 10 WHEN 8 THEN 2 ELSE 0 END AS INT) AS masked, CASE c_custkey % 10 WHEN 8 THEN 2 ELSE 0 END AS line_ends FROM customer
""")
def redact_spans(spark, sf_dir):
    """The nine detectors' findings with their places, overlaps included."""
    rows = derived.records(spark, sf_dir, _LETTERS, "customer")
    return redact.findings(redact.redact(rows)).select("history_id", "start", "end", "detector", "masked", "line_ends")


@query(f"""
SELECT 'u' || CAST(c_custkey AS STRING) AS history_id, side FROM customer, (VALUES ('expected'), ('given')) v(side) WHERE c_custkey % 4 = 0
""")
def redaction_replay(spark, sf_dir):
    """Masked texts that are not what masking gives, by their originals."""
    rows = derived.records(spark, sf_dir, _LETTERS, "customer")
    masked = redact.redact(rows)
    bent = masked.withColumn("content", F.when(F.substring("history_id", 2, 20).cast("bigint") % 4 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return redact.verify_redaction(rows, bent).select("history_id", "side")


# ---- archive ----

_TURNS = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"


@query(f"""
SELECT history_id, code, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT DISTINCT 'v' || conv_id AS history_id, 'position' AS code, n - 2 AS n FROM ({_TURNS}) t WHERE conv_id % 5 = 1
  UNION ALL SELECT DISTINCT 'v' || conv_id, 'link', CASE WHEN n > 2 THEN 1 ELSE 0 END FROM ({_TURNS}) t WHERE conv_id % 5 = 1
  UNION ALL SELECT 'v' || conv_id, code, 1 FROM ({_TURNS}) t, (VALUES ('link'), ('entry')) v(code) WHERE conv_id % 5 = 2 AND pos = 1
  UNION ALL SELECT 'v' || conv_id, 'entry', 1 FROM ({_TURNS}) t WHERE conv_id % 5 = 3 AND pos = 0
  UNION ALL SELECT DISTINCT 'v' || conv_id, 'head', 1 FROM ({_TURNS}) t WHERE conv_id % 5 = 4 OR (conv_id % 5 = 1 AND n = 2)
) x WHERE n > 0 GROUP BY history_id, code
""")
def archive_faults(spark, sf_dir):
    """A lost, a relinked, a shifted and a cut off record, each found by its rule."""
    kept = archive.archived(derived.conversations(spark, sf_dir))
    heads = kept.groupBy("history_id").agg(F.max_by("entry", "position").alias("head"))
    last = kept.groupBy("history_id").agg(F.max("position").alias("last"))
    n = F.substring("history_id", 2, 20).cast("bigint") % 5
    place = F.col("position")
    shifted = (n == 3) & (place == 0)
    bent = kept.join(last, "history_id").where(~((n == 1) & (place == 1)) & ~((n == 4) & (place == F.col("last")))).drop("last")
    bent = settle(
        bent.withColumns(
            {
                "previous": F.when((n == 2) & (place == 1), F.lit("0" * 64)).otherwise(F.col("previous")),
                "content": F.when(shifted, F.concat(F.right("role", F.lit(1)), "content")).otherwise(F.col("content")),
                "role": F.when(shifted, F.expr("left(role, length(role) - 1)")).otherwise(F.col("role")),
            }
        )
    )
    found = archive.verify(bent).select("history_id", "code").unionByName(archive.verify_heads(bent, heads).select("history_id", F.lit("head").alias("code")))
    return found.groupBy("history_id", "code").agg(F.count("*").alias("n"))


# ---- sources and sinks ----

_ID = "'s' || lpad(CAST(turn AS VARCHAR), 6, '0') || '-' || substr(sha256(length(role) || ':' || role || length(text) || ':' || text), 1, 20)"


@query(f"""
SELECT 'v' || conv_id AS history_id, CASE WHEN turn % 2 = 0 THEN 't' || turn ELSE {_ID} END AS source_id, CAST(turn AS BIGINT) AS sequence, role, text AS content,
       '{{"n":' || length(text) || '}}' AS metadata, role = 'assistant' AND turn % 3 = 0 AS untrusted FROM conversations
""")
def records_reread(spark, sf_dir):
    """Records written as JSON lines and read back, with ids and trust by default."""
    folder = f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("history_id"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("id"),
        F.col("turn").alias("sequence"), "role", F.col("text").alias("content"),
        F.struct(F.length("text").alias("n")).alias("metadata"),
        F.when(F.col("turn") % 3 == 0, F.struct(F.lit(False).alias("trusted_for_state"))).alias("authority"),
    )
    source.write_json(rows, folder)
    return source.read_json(spark, folder).select("history_id", "source_id", "sequence", "role", "content", "metadata", "untrusted")


@query("""
SELECT 's' || p_size AS history_id, '<typed_memory schema="1.0" content="untrusted-jsonl">' || chr(10) || 'progress:' || chr(10)
       || string_agg('- {"text":"' || 'a\\u003cb\\u0026\\u003e ' || p_partkey || '","status":"active","exact":false,"source_roles":["user"],"provenance":["s0:0-3#2c26b46b68"]}', chr(10) ORDER BY p_partkey)
       || chr(10) || '</typed_memory>' AS prompt
FROM part GROUP BY p_size
""")
def rendered_prompts(spark, sf_dir):
    """K2: prompts of chosen items, what looks like markup escaped."""
    items = named_items(spark, sf_dir).withColumn("text", F.concat(F.lit("a<b&> "), "id"))
    spot = F.struct(F.lit("s0").alias("source_id"), F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("foo").alias("quote"))
    items = items.withColumn("provenance", F.array(spot))
    return select.render(items, items.groupBy("history_id").agg(F.collect_list("id").alias("selected")))


@query("""
SELECT history_id, place, CASE WHEN length(shown) > 40 THEN substr(shown, 1, 40) || '…' ELSE shown END AS text FROM (
  SELECT 's' || p_size AS history_id, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INT) AS place, 'x\\u0007\\u000a\\\\' || p_name || repeat('y', p_partkey % 40) AS shown FROM part) x
WHERE place <= 5
""")
def inspected_items(spark, sf_dir):
    """The first items of each history, shortened, with control characters as their code points."""
    items = named_items(spark, sf_dir).withColumn("text", F.concat(F.lit("x\u0007\n\\"), "text", F.expr("repeat('y', CAST(sequence % 40 AS INT))")))
    return report.inspect(items, most_items=5, most_chars=40).select("history_id", "place", "text")


# ---- trust ----


@query("""
SELECT sources, anchor, archive, artifact, passed, count(*) AS n FROM (
  SELECT p_size, p_size % 5 <> 1 AS sources, p_size % 5 <> 2 AS anchor, p_size % 5 <> 3 AS archive, p_size % 5 <> 4 AS artifact, p_size % 5 = 0 AS passed FROM (SELECT DISTINCT p_size FROM part) s) x
GROUP BY sources, anchor, archive, artifact, passed
""")
def manifest_checks(spark, sf_dir):
    """Manifests against changed sources, anchors, archives and artifacts."""
    items = settle(named_items(spark, sf_dir).repartition("history_id"))
    rows = items.select("history_id", F.col("id").alias("source_id"), "sequence", F.lit("user").alias("role"), F.col("text").alias("content"))
    heads = settle(archive.heads(rows))
    summary = items.select("history_id").distinct().withColumn("passed", F.lit(True))
    made = settle(report.manifest(rows, items, summary, heads))
    n = F.substring("history_id", 2, 20).cast("bigint") % 5
    swap = lambda k, column: F.when(n == k, F.concat(column, F.lit("!"))).otherwise(F.col(column))
    anchors = made.select("history_id", F.col("manifest_sha256").alias("expected")).withColumn("expected", swap(2, "expected"))
    told = report.verify_manifest(made, anchors, rows.withColumn("content", swap(1, "content")), items.withColumn("text", swap(4, "text")), heads.withColumn("head", swap(3, "head")))
    return told.groupBy("sources", "anchor", "archive", "artifact", "passed").agg(F.count("*").alias("n"))


@query("SELECT 's' || p_size AS history_id, p_size % 3 = 0 AS supported FROM (SELECT DISTINCT p_size FROM part) s")
def schema_versions(spark, sf_dir):
    """Which artifacts' schema versions can be read."""
    rows = table(spark, sf_dir, "part").select("p_size").distinct()
    version = F.when(F.col("p_size") % 3 == 0, "1.0").when(F.col("p_size") % 3 == 1, "9.9")
    return report.schema_support(rows.select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("history_id"), version.alias("schema_version"))).select("history_id", "supported")


# ---- extractors ----


@query(f"""
SELECT 'p' || {K} AS history_id, CASE p_partkey % 6 WHEN 0 THEN 'kept' WHEN 1 THEN 'kind' WHEN 2 THEN 'tag' WHEN 3 THEN 'literal' WHEN 4 THEN 'uncertain' ELSE 'authority' END AS outcome FROM part
""")
def decoded_claims(spark, sf_dir):
    """G15, UD5: a model's claims, each kept or rejected for its reason."""
    rows = faults.records(spark, sf_dir)
    k = F.col("p_partkey")
    at = F.length(F.concat(F.lit("goal: seal crate "), k.cast("string"), F.lit("\nconstraint: ")))
    kind = F.when(k % 6 == 1, "nothing").when(k % 6 == 4, "confirmed_fact").otherwise("constraint")
    source_id = F.when(k % 6 == 4, "s2").when(k % 6 == 5, "s1").otherwise("s0")
    asked = F.concat(F.lit("Is the weight of crate "), k.cast("string"), F.lit(" known?"))
    text = F.when(k % 6 == 3, "the belt must be open").when(k % 6 == 4, asked).when(k % 6 == 5, "exit code 3").otherwise("the belt must be closed")
    start = F.when(k % 6 > 3, 0).otherwise(at)
    end = F.when(k % 6 == 4, F.length(asked)).when(k % 6 == 5, 11).otherwise(at + 23)
    tags = F.when(k % 6 == 2, F.array(F.lit("current-value")))
    claim = F.struct(kind.alias("kind"), text.alias("text"), tags.alias("tags"), F.array(F.struct(source_id.alias("source_id"), start.alias("start"), end.alias("end"))).alias("provenance"))
    given = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("history_id"), F.to_json(F.struct(F.array(claim).alias("items"))).alias("response"))
    items, rejected = plugins.decode(given, rows)
    return items.select("history_id", F.lit("kept").alias("outcome")).unionByName(rejected.select("history_id", F.col("reason").alias("outcome")))


@query(f"""
SELECT 'p' || {K} AS history_id, 'keep ' || p_name AS text, 12 AS start FROM part UNION ALL SELECT 'p' || {K}, 'second', CAST(20 + length(p_name) AS INT) FROM part
""")
def domain_labels(spark, sf_dir):
    """G14, UD7: items of a caller's own labels."""
    content = F.concat(F.lit("Guard_rail: keep "), "p_name", F.lit("\n- second\nno item"))
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("history_id"), F.lit("s0").alias("source_id"), F.lit(0).cast("bigint").alias("sequence"), F.lit("user").alias("role"),
        content.alias("content"), F.lit(False).alias("trusted"), F.lit(False).alias("untrusted"),
    )
    found = extract.extract_labels(rows, {"guard rail": "context"})
    return found.select("history_id", "text", F.get("provenance", F.lit(0))["start"].alias("start"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 3 END AS start, CASE p_partkey % 4 WHEN 0 THEN CAST(3 + length(p_name) AS INT) END AS "end",
       CASE p_partkey % 4 WHEN 1 THEN 'repeated' WHEN 2 THEN 'missing' WHEN 3 THEN 'source' END AS reason FROM part
""")
def literal_places(spark, sf_dir):
    """Texts that occur exactly once, and why others have no place."""
    k = F.col("p_partkey")
    base = table(spark, sf_dir, "part").select(k, F.concat(F.lit("p"), k.cast("string")).alias("history_id"), "p_name")
    rows = base.select("history_id", F.lit("s0").alias("source_id"), F.concat(F.lit("at "), "p_name", F.when(k % 4 == 1, F.concat(F.lit(" "), "p_name")).otherwise("")).alias("content"))
    asked = base.select(
        "history_id", F.when(k % 4 == 3, "s9").otherwise("s0").alias("source_id"), F.lit("context").alias("kind"), F.when(k % 4 == 2, F.concat(F.lit("no "), "p_name")).otherwise(F.col("p_name")).alias("text")
    )
    return extract.locate_literals(asked, rows).select(F.substring("history_id", 2, 20).cast("bigint").alias("p_partkey"), "start", "end", "reason")


# ---- evaluation ----


@query("""
SELECT history_id, count(*) AS n_atoms, count(*) FILTER (hit) AS n_hits FROM (
  SELECT 's' || p_size AS history_id, p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AS hit FROM part) x GROUP BY history_id
""")
def atom_hits(spark, sf_dir):
    """Gold atoms that a claim states with the same span and normal text."""
    k = F.col("p_partkey")
    gold = table(spark, sf_dir, "part").select(
        F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("history_id"), k.alias("atom_id"), F.lit("context").alias("kind"), F.col("p_name").alias("text"),
        k.cast("string").alias("source_id"), F.lit(2).alias("start"), (F.length("p_name") + 2).alias("end"),
    )
    spot = F.struct("source_id", F.when(F.col("atom_id") % 4 == 0, 1).otherwise(F.col("start")).alias("start"), "end")
    claims = gold.select("history_id", "kind", F.when(F.col("atom_id") % 3 == 0, F.lit("other")).otherwise(F.concat(F.upper("text"), F.lit(" ."))).alias("text"), F.array(spot).alias("provenance"))
    return evaluate.atom_matches(gold, claims).groupBy("history_id").agg(F.count("*").alias("n_atoms"), F.count_if("hit").alias("n_hits"))


@query("""
SELECT 's' || p_size AS history_id, label FROM (
  SELECT p_size, CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_partkey WHEN p_partkey % 6 = 1 THEN 'a' || p_partkey WHEN p_partkey % 6 = 3 THEN 'r' || p_partkey END AS label FROM part) x WHERE label IS NOT NULL
""")
def adjudicated_labels(spark, sf_dir):
    """Consensus, and of the rest what was accepted or replaced."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("history_id"), F.concat(F.lit("a"), k.cast("string")).alias("label"))
    resolution = F.when(k % 6 == 1, "accept").when(k % 6 == 3, "replace").otherwise("reject")
    decisions = rows.where(k % 2 == 1).select("history_id", "label", resolution.alias("resolution"), F.concat(F.lit("r"), k.cast("string")).alias("replacement"))
    return evaluate.adjudicate(rows.select("history_id", "label"), rows.where(k % 2 == 0).select("history_id", "label"), decisions)


@query("""
SELECT p_size, 'n' AS value FROM (SELECT DISTINCT p_size FROM part) s WHERE p_size % 4 = 0
UNION ALL SELECT p_size, 'total' FROM (SELECT DISTINCT p_size FROM part) s WHERE p_size % 6 = 0
""")
def reconciled_report(spark, sf_dir):
    """AG15, E10: values that a report states and a recount does not give."""
    counted = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"), F.sum(F.col("p_partkey")).alias("total"))
    stated = counted.select("p_size", F.when(F.col("p_size") % 4 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n"), F.when(F.col("p_size") % 6 == 0, F.lit(None).cast("bigint")).otherwise(F.col("total")).alias("total"))
    return evaluate.reconcile(stated, counted, ["p_size"], ["n", "total"])


@query("""
SELECT max_by(s_name, struct_pack(a := s_suppkey % 3, b := s_suppkey % 5, c := s_suppkey % 7, d := s_name)) AS system FROM supplier
""")
def strongest_system(spark, sf_dir):
    """AG14: the best of many systems, ties broken in order."""
    k = F.col("s_suppkey")
    return evaluate.strongest(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("system"), (k % 3).alias("recall"), (k % 5).alias("exact_recall"), (k % 7).alias("quality")))


@query("""
SELECT sum(hits) / sum(total) AS pooled, avg(CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE hits / total END) AS mean, count(*) AS n_histories FROM (
  SELECT p_size, sum(CASE WHEN p_size % 4 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) * 0 + CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS hits, CASE WHEN p_size % 4 = 0 THEN 0 WHEN p_size % 4 = 1 THEN 1 ELSE 2 END AS total FROM part GROUP BY p_size) x
""")
def pooled_recall(spark, sf_dir):
    """AG7, AG8: a pooled ratio and the mean of histories' ratios, nothing of nothing being all."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_size").distinct()
    rows = rows.select(F.when(size % 4 == 0, 0).otherwise(1).alias("hits"), F.when(size % 4 == 0, 0).when(size % 4 == 1, 1).otherwise(2).alias("total"))
    return evaluate.pooled(rows, "hits", "total")


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN 3.0::DOUBLE / (1.0::DOUBLE / ((s_suppkey % 4) / 4.0::DOUBLE) + 1.0::DOUBLE / (1.0::DOUBLE / (1 + s_suppkey % 3)) + 1.0::DOUBLE / 0.5::DOUBLE) ELSE 0.0::DOUBLE END AS quality FROM supplier
""")
def quality_scores(spark, sf_dir):
    """AG8: harmonic mean of a row's metrics, 0 where one is 0."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k, evaluate.harmonic((k % 4) / F.lit(4.0), F.lit(1.0) / (1 + k % 3), F.lit(0.5)).alias("quality"))


@query("""
SELECT 's' || p_size AS history_id, count(*) FILTER (p_partkey % 3 = 0) AS n_gained, count(*) FILTER (p_partkey % 3 = 1) AS n_lost FROM part GROUP BY p_size
""")
def selection_changes(spark, sf_dir):
    """What selections gained and lost between two snapshots."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("history_id"))
    picked = lambda rule: rows.groupBy("history_id").agg(F.collect_list(F.when(rule, k.cast("string"))).alias("selected"))
    told = report.diff_selection(picked(k % 3 != 0), picked(k % 3 != 1))
    return told.select("history_id", F.size("gained").cast("bigint").alias("n_gained"), F.size("lost").cast("bigint").alias("n_lost"))


@query(f"SELECT kind, count(*) AS n FROM ({faults.EXPECTED}) e WHERE kind IN ('goal', 'exact_error', 'exact_reference') GROUP BY kind UNION ALL SELECT 'constraint', count(*) * 6 FROM part UNION ALL SELECT 'unresolved', count(*) FROM part UNION ALL SELECT 'user_correction', count(*) FROM part")
def protected_items(spark, sf_dir):
    """Extraction of the kinds that may never be lost."""
    return extract.extract(faults.records(spark, sf_dir), protected_only=True).groupBy("kind").agg(F.count("*").alias("n"))


@query("""
SELECT 's' || p_size AS history_id, count(*) AS n_selected FROM part WHERE p_partkey % 2 = 0 GROUP BY p_size
""")
def prompt_items(spark, sf_dir):
    """Of all items of a ledger the active ones only are chosen."""
    items = named_items(spark, sf_dir).withColumn("status", F.when(F.col("sequence") % 2 == 0, "active").otherwise("superseded"))
    wide = items.groupBy("history_id").agg(F.lit(100_000_000).cast("bigint").alias("n_chars"))
    chosen = select.select(items, wide, select.Policy(token_budget=10_000_000, minimum_ratio=1.0)).select("history_id", F.size("selected").cast("bigint").alias("n_selected"))
    return chosen.where("n_selected > 0")




# ---- artifacts ----


def _artifacts(spark, sf_dir):
    """Named items as artifacts: items, records, artifacts of whole and of active ledgers."""
    items = settle(named_items(spark, sf_dir))
    rows = items.select("history_id", F.col("id").alias("source_id"), "sequence", F.lit("user").alias("role"), F.col("text").alias("content"))
    chosen, summary = packed(items), items.select("history_id").distinct().withColumn("passed", F.lit(True))
    whole, active = (artifact.build(items, chosen, summary, rows, active_only=a) for a in (False, True))
    return items, rows, whole, active


@query("SELECT 's' || p_size AS history_id, CAST(p_partkey AS VARCHAR) AS id, p_name AS text, p_partkey AS sequence FROM part")
def artifact_items(spark, sf_dir):
    """Items written into artifacts and read back."""
    _, _, whole, _ = _artifacts(spark, sf_dir)
    return artifact.items_of(artifact.load(whole)).select("history_id", "id", "text", "sequence")


@query("""
SELECT 's' || p_size AS history_id, code FROM (SELECT DISTINCT p_size FROM part) s, (VALUES (1, 'invalid_artifact_json'), (2, 'unsupported_schema_version'), (2, 'artifact_digest_mismatch'),
  (3, 'artifact_digest_mismatch'), (4, 'incomplete_ledger'), (5, 'source_digest_mismatch'), (5, 'source_count_mismatch'), (6, 'invalid_artifact_json'), (7, 'invalid_artifact_json')) v(fault, code) WHERE p_size % 8 = fault
""")
def artifact_checks(spark, sf_dir):
    """Artifacts cut off, of another version, altered, active only, of other records, with unknown or repeated fields."""
    _, rows, whole, active = _artifacts(spark, sf_dir)
    n = F.substring("history_id", 2, 20).cast("int") % 8
    text = F.col("artifact")
    bent = (
        F.when(n == 1, F.expr("left(artifact, length(artifact) - 9)"))
        .when(n == 2, F.replace(text, F.lit('"schema_version":"1.0"'), F.lit('"schema_version":"9.9"')))
        .when(n == 3, F.replace(text, F.lit('"status":"active"'), F.lit('"status":"discarded"')))
        .when(n == 6, F.replace(text, F.lit('{"schema_version"'), F.lit('{"own":1,"schema_version"')))
        .when(n == 7, F.replace(text, F.lit('{"schema_version"'), F.lit('{"passed":true,"schema_version"')))
        .otherwise(text)
    )
    given = whole.where(n != 4).unionByName(active.where(n == 4)).withColumn("artifact", bent)
    first = rows.groupBy("history_id").agg(F.min("sequence").alias("first"))
    kept = rows.join(first, "history_id").where((n != 5) | (F.col("sequence") > F.col("first"))).drop("first")
    return artifact.issues(artifact.load(given), kept)
