"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.tables import settle, shared_dir, unnest
from ..operators import archive, evaluate, extract, redact, report, resolve, select, verify
from ..sources import derived
from ..streaming import ingest
from .compile import compile_histories, source_chars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(derived.records(spark, sf_dir))


# ---- extraction ----


@query(f"SELECT kind, count(*) AS n_items, count(DISTINCT history_id) AS n_histories FROM ({derived.EXPECTED}) e GROUP BY kind")
def extracted_kinds(spark, sf_dir):
    """Items by kind."""
    return order_items(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n_items"), F.count_distinct("history_id").alias("n_histories"))


@query(f"""
SELECT e.history_id, e.source_id, e.sequence, e.kind, e.text, CAST(instr(r.content, e.text) - 1 AS INT) AS span_start,
       CAST(instr(r.content, e.text) - 1 + length(e.text) AS INT) AS span_end
FROM ({derived.EXPECTED}) e JOIN ({derived.RECORDS}) r ON e.history_id = r.history_id AND e.source_id = r.source_id
""")
def extracted_spans(spark, sf_dir):
    """Every claim with its place."""
    p = F.get("provenance", F.lit(0))
    return order_items(spark, sf_dir).select("history_id", p["source_id"].alias("source_id"), "sequence", "kind", "text", p["start"].alias("span_start"), p["end"].alias("span_end"))


@query("""
SELECT doc_id, count(*) AS n_lines, CAST(max(start) AS BIGINT) AS last_start, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS start
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
) WHERE line <> '' GROUP BY doc_id
""")
def line_offsets(spark, sf_dir):
    """Lines of documents and where they start."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("history_id"), F.lit("s").alias("source_id"), F.lit(0).alias("sequence"), F.lit("user").alias("role"),
        F.col("text").alias("content"), F.lit(False).alias("trusted"), F.lit(False).alias("untrusted"),
    )
    rows = extract.lines(docs).where("line <> ''")
    return rows.groupBy(F.col("history_id").cast("bigint").alias("doc_id")).agg(
        F.count("*").alias("n_lines"), F.max("line_start").cast("bigint").alias("last_start"), F.sum(F.length("line")).alias("n_chars")
    )


@query("""
SELECT p_partkey, word, CAST(pos AS INT) AS start FROM (
  SELECT p_partkey, unnest(regexp_extract_all(p_name, '[A-Za-z]+')) AS word, unnest(list_transform(range(1, len(string_split_regex(p_name, '[A-Za-z]+'))),
    lambda i: length(array_to_string(list_transform(range(1, i + 1), lambda j: string_split_regex(p_name, '[A-Za-z]+')[j]), '')) + CASE WHEN i = 1 THEN 0 ELSE length(array_to_string(list_transform(range(1, i), lambda j: regexp_extract_all(p_name, '[A-Za-z]+')[j]), '')) END)) AS pos
  FROM part)
""")
def match_spans(spark, sf_dir):
    """Matches of a pattern with their offsets."""
    rows = unnest(table(spark, sf_dir, "part"), ["p_partkey"], tx.matches(F.col("p_name"), "[A-Za-z]+"), "m")
    return rows.select("p_partkey", F.col("m.text").alias("word"), F.col("m.start").cast("int").alias("start"))


@query("""
SELECT o_orderkey, trim(clause) AS clause, CAST(instr(note, trim(clause)) - 1 AS INT) AS start FROM (
  SELECT o_orderkey, note, unnest(string_split(note, ';')) AS clause FROM (
    SELECT o_orderkey, 'first ' || o_orderkey || ' a;  second ' || o_orderpriority || ';third ' || o_orderstatus || ' c' AS note FROM orders))
""")
def clause_offsets(spark, sf_dir):
    """Semicolon clauses with their offsets."""
    key = F.col("o_orderkey").cast("string")
    note = F.concat(F.lit("first "), key, F.lit(" a;  second "), "o_orderpriority", F.lit(";third "), "o_orderstatus", F.lit(" c"))
    rows = unnest(table(spark, sf_dir, "orders"), ["o_orderkey"], extract.semicolon_clauses(note), "c")
    return rows.select("o_orderkey", F.col("c.text").alias("clause"), F.col("c.start").cast("int").alias("start"))


_KIND = "CASE WHEN o_orderkey % 4 = 0 THEN 'user' WHEN o_orderkey % 4 = 1 THEN 'assistant' WHEN o_orderkey % 4 = 2 THEN 'tool' ELSE 'Developer' END"
_LINES = [
    "Actually use lane two", "tried packing but it failed", "the dock must stay open", "please check the scale",
    "fix the label printer", "the weight may vary", "we will repack the order", "verified by the clerk", "nothing to report",
]
_LINE = "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LINES)) + " END"


@query(f"""
SELECT role, line, kind, count(*) AS n FROM (
  SELECT role, line, CASE
    WHEN commits AND line LIKE 'Actually%' THEN 'user_correction' WHEN line LIKE 'tried%' THEN 'discarded_attempt'
    WHEN commits AND line LIKE '%must%' THEN 'constraint' WHEN role = 'user' AND line LIKE 'please%' THEN 'goal'
    WHEN commits AND line LIKE 'fix%' THEN 'goal' WHEN states AND line LIKE '%may%' THEN 'unresolved'
    WHEN states AND line LIKE 'we will%' THEN 'decision' WHEN states AND line LIKE 'verified%' THEN 'confirmed_fact' ELSE 'none' END AS kind
  FROM (SELECT *, role IN ('user', 'Developer') AS commits, role <> 'tool' AS states FROM (SELECT {_KIND} AS role, {_LINE} AS line FROM orders))
) GROUP BY role, line, kind
""")
def classify_cascade(spark, sf_dir):
    """Kinds of free lines by role."""
    rows = table(spark, sf_dir, "orders").selectExpr(f"{_KIND} AS role", f"{_LINE} AS line")
    kind = extract.classify(F.col("line"), F.col("role"), extract.in_role(F.col("role"), lx.STATE_ROLES))
    return rows.withColumn("kind", F.coalesce(kind, F.lit("none"))).groupBy("role", "line", "kind").agg(F.count("*").alias("n"))


# ---- state ----

_NORM = "regexp_replace(lower(text), '[.?]+$', '')"


@query(f"""
SELECT history_id, kind, min_by(text, sequence * 1000000000 + CAST(substr(source_id, 2) AS BIGINT)) AS text, count(DISTINCT source_id) AS n_sources, max(sequence) AS last_sequence
FROM ({derived.EXPECTED}) e GROUP BY history_id, kind, {_NORM.replace('?', '')}
""")
def canonical_items(spark, sf_dir):
    """AG1, R1: equal claims of a history merged."""
    items = resolve.canonicalize(order_items(spark, sf_dir))
    return items.select("history_id", "kind", "text", F.size(F.array_distinct(F.transform("provenance", lambda p: p["source_id"]))).cast("bigint").alias("n_sources"), F.col("sequence").alias("last_sequence"))


@query(f"""
SELECT kind, CASE WHEN kind = 'unresolved' THEN 'q' ELSE 'x' END AS family, count(*) AS n FROM (
  SELECT DISTINCT history_id, kind, lower(text) AS text FROM ({derived.EXPECTED}) e) GROUP BY kind, family
""")
def ledger_kind_counts(spark, sf_dir):
    """G2, G3, AG1, AG3: merged claims by kind."""
    items = resolve.canonicalize(order_items(spark, sf_dir))
    return items.groupBy("kind", F.when(F.col("kind") == "unresolved", "q").otherwise("x").alias("family")).agg(F.count("*").alias("n"))


@query(f"""
WITH c AS (SELECT DISTINCT history_id, text FROM ({derived.EXPECTED}) e WHERE kind = 'constraint')
SELECT history_id, count(*) AS n_pairs FROM (
  SELECT a.history_id FROM c a JOIN c b ON a.history_id = b.history_id AND a.text < b.text
  WHERE (a.text LIKE 'the order limit%' AND b.text LIKE 'the order limit%') OR (a.text LIKE 'The audit%' AND b.text LIKE 'The audit%')
) GROUP BY history_id
""")
def conflict_pairs(spark, sf_dir):
    """Contradicting pairs of each history."""
    return resolve.conflict_pairs(resolve.canonicalize(order_items(spark, sf_dir))).groupBy("history_id").agg(F.count("*").alias("n_pairs"))


@query()
def resolved_status(spark, sf_dir):
    """Status of the ledger's items after corrections, answers and conflicts."""
    return report.counts(resolve.resolve(order_items(spark, sf_dir)))


@query("""
SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n_links FROM nation GROUP BY n_regionkey
""")
def correction_links(spark, sf_dir):
    """Each nation corrects its number once, and each correction links to what it replaces."""
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("history_id"), F.col("n_nationkey").alias("k"))
    word = F.element_at(F.array(*[F.lit(w) for w in ("alpha", "beta", "gamma", "delta", "omega")]), (F.col("k") % 5 + 1).cast("int"))
    both = F.array(
        F.struct(F.lit("a").alias("source_id"), F.lit(0).cast("bigint").alias("sequence"), F.concat(F.lit("constraint: the "), word, F.lit(" queue limit must be "), (F.col("k") + 10).cast("string")).alias("content")),
        F.struct(F.lit("b").alias("source_id"), F.lit(1).cast("bigint").alias("sequence"), F.concat(F.lit("Actually, the "), word, F.lit(" queue limit must be "), (F.col("k") + 50).cast("string"), F.lit(" instead")).alias("content")),
    )
    told = rows.select("history_id", "n_regionkey", F.explode(both).alias("r")).select("history_id", "n_regionkey", "r.*")
    recs = told.select("history_id", "source_id", "sequence", F.lit("user").alias("role"), "content", F.lit(False).alias("trusted"), F.lit(False).alias("untrusted"))
    ledger = resolve.resolve(extract.extract(recs))
    linked = ledger.where((F.col("kind") == "user_correction") & (F.size("supersedes") == 1)).select("history_id")
    return rows.join(linked, "history_id").groupBy("n_regionkey").agg(F.count("*").alias("n_links"))


# ---- selection, baselines ----


_PACK = """
WITH RECURSIVE t AS (
  SELECT 's' || p_size AS history_id, p_partkey, p_name, length('- {"text":"' || p_name || '","status":"active","exact":false,"source_roles":["user"],"provenance":[]}') + 1 AS size,
         row_number() OVER (PARTITION BY p_size ORDER BY p_partkey DESC) AS pos
  FROM part
), walk AS (
  SELECT history_id, 0::BIGINT AS pos, 69::BIGINT AS chars, 0::BIGINT AS taken, 0::BIGINT AS last FROM t WHERE pos = 1
  UNION ALL
  SELECT t.history_id, t.pos, CASE WHEN ok THEN grown ELSE chars END, taken + CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN ok THEN p_partkey ELSE last END
  FROM (SELECT w.*, t.pos AS next, t.size, t.p_partkey, chars + t.size + CASE WHEN taken = 0 THEN 10 ELSE 0 END AS grown, ceil((chars + t.size + CASE WHEN taken = 0 THEN 10 ELSE 0 END) / 4.0) <= 300 AS ok
        FROM walk w JOIN t ON t.history_id = w.history_id AND t.pos = w.pos + 1) t(history_id, before, chars, taken, last, pos, size, p_partkey, grown, ok)
)
SELECT history_id, max_by(taken, pos) AS n_selected, CAST(max_by(chars, pos) AS BIGINT) AS prompt_chars, CAST(ceil(max_by(chars, pos) / 4.0) AS BIGINT) AS prompt_tokens, CAST(max_by(last, pos) AS BIGINT) AS last_taken
FROM walk GROUP BY history_id
"""


def named_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a size as one history of optional items, one for each part."""
    none, strings = F.array(), "array<string>"
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("history_id"), F.col("p_partkey").cast("string").alias("id"), F.lit("progress").alias("kind"), F.col("p_name").alias("text"),
        F.lit("active").alias("status"), F.lit(45).alias("priority"), F.lit(1.0).alias("confidence"), F.lit(False).alias("exact"), none.cast(strings).alias("tags"), none.cast(strings).alias("supersedes"),
        none.cast(strings).alias("conflicts_with"), none.cast("array<struct<source_id:string,start:int,end:int,quote:string>>").alias("provenance"), F.col("p_partkey").alias("sequence"),
        F.array(F.lit("user")).alias("roles"), F.array(F.lit("own")).alias("extractors"),
    )


def packed(items: DataFrame) -> DataFrame:
    wide = items.groupBy("history_id").agg(F.lit(1_000_000).cast("bigint").alias("n_chars"))
    return select.select(items, wide, select.Policy(token_budget=300, minimum_ratio=1.0))


@query(_PACK)
def budget_pack(spark, sf_dir):
    """Greedy first fit with skipping by the selection operator, item by item."""
    out = packed(named_items(spark, sf_dir))
    return out.select("history_id", F.size("selected").cast("bigint").alias("n_selected"), "prompt_chars", "prompt_tokens", F.get("selected", F.size("selected") - 1).cast("bigint").alias("last_taken"))


_CUT = """
SELECT history_id, count(*) AS n_turns, CAST(sum(least(n, rest)) AS BIGINT) AS n_chars FROM (
  SELECT 'v' || conv_id AS history_id, length(text) AS n, 1000 - coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM conversations) WHERE rest > 0 GROUP BY history_id
"""


@query(_CUT.format(order=""))
def head_baseline(spark, sf_dir):
    """The first 1000 characters of each conversation."""
    return evaluate.truncate(derived.conversations(spark, sf_dir), 1000).groupBy("history_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("content")).alias("n_chars"))


@query(_CUT.format(order="DESC"))
def tail_baseline(spark, sf_dir):
    """The last 1000 characters of each conversation."""
    return evaluate.truncate(derived.conversations(spark, sf_dir), 1000, tail=True).groupBy("history_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("content")).alias("n_chars"))


@query()
def selected_memory(spark, sf_dir):
    """Each history's selection and token account."""
    records = derived.records(spark, sf_dir)
    ledger = resolve.canonicalize(extract.extract(records))
    chosen = select.select(ledger, source_chars(records), select.Policy(token_budget=600, minimum_ratio=1.0))
    return chosen.select("history_id", F.size("selected").alias("n_selected"), "prompt_tokens", "protected_tokens", "budget", "overflow", "target_met")


# ---- verification ----


@query(f"""
SELECT code, count(*) AS n FROM (
  SELECT 'unauthorized_fact_source' AS code FROM ({derived.EXPECTED}) e WHERE role = 'tool' AND kind = 'exact_error'
  UNION ALL SELECT 'exact_literal_changed' FROM ({derived.EXPECTED}) e WHERE kind = 'exact_reference'
  UNION ALL SELECT 'source_sequence_metadata_mismatch' FROM ({derived.EXPECTED}) e WHERE kind = 'goal'
  UNION ALL SELECT 'invalid_provenance' FROM ({derived.EXPECTED}) e WHERE kind = 'progress'
) GROUP BY code
""")
def verified_corruptions(spark, sf_dir):
    """Seeded faults are found, and of these codes nothing else."""
    records = derived.records(spark, sf_dir)
    items = extract.extract(records)
    kind = F.col("kind")
    bent = items.withColumns(
        {
            "text": F.when(kind == "exact_reference", F.concat("text", F.lit("x"))).otherwise(F.col("text")),
            "sequence": F.when(kind == "goal", F.col("sequence") + 1).otherwise(F.col("sequence")),
            "provenance": F.when(kind == "progress", F.transform("provenance", lambda p: F.struct(p["source_id"].alias("source_id"), (p["start"] + 1).alias("start"), p["end"].alias("end"), p["quote"].alias("quote")))).otherwise(F.col("provenance")),
            "kind": F.when(kind == "exact_error", "confirmed_fact").otherwise(kind),
        }
    )
    codes = ["unauthorized_fact_source", "exact_literal_changed", "source_sequence_metadata_mismatch", "invalid_provenance"]
    found = verify.item_issues(bent, records).where(F.col("code").isin(codes))
    return found.groupBy("code").agg(F.count("*").alias("n"))


@query(f"SELECT source_id, text FROM ({derived.EXPECTED}) e WHERE kind IN ('goal', 'constraint', 'unresolved', 'exact_error', 'exact_reference') AND CAST(substr(source_id, 2) AS BIGINT) % 3 = 0")
def missing_obligations(spark, sf_dir):
    """Protected claims that a thinned ledger lacks."""
    items = settle(order_items(spark, sf_dir))
    source = F.get("provenance", F.lit(0))["source_id"]
    kept = items.where(F.substring(source, 2, 20).cast("bigint") % 3 != 0)
    wanted = items.where(F.col("kind").isin(lx.PROTECTED))
    lost = wanted.join(verify.covered(wanted, kept), ["history_id", "id"], "left_anti")
    return lost.select(source.alias("source_id"), "text")


@query()
def compiled_summary(spark, sf_dir):
    """The whole compilation of all histories: verdicts by code."""
    done = compile_histories(derived.records(spark, sf_dir))
    return done.summary.groupBy("passed", "codes").agg(F.count("*").alias("n_histories"), F.sum("errors").alias("n_errors"), F.sum("warnings").alias("n_warnings"))


# ---- redaction ----


@query("""
SELECT CASE doc_id % 6 WHEN 0 THEN 'openai_style_key' WHEN 1 THEN 'github_token' WHEN 2 THEN 'aws_access_key_id' WHEN 3 THEN 'credential_assignment' WHEN 4 THEN 'bearer_token' ELSE 'url_userinfo' END AS detector,
       count(*) AS n_findings, count(*) AS n_sources,
       CAST(sum(CASE doc_id % 6 WHEN 0 THEN 35 WHEN 1 THEN 36 WHEN 2 THEN 20 WHEN 3 THEN 12 WHEN 4 THEN 32 ELSE 10 + length(CAST(doc_id AS VARCHAR)) END) AS BIGINT) AS n_masked
FROM documents GROUP BY 1
""")
def redact_findings(spark, sf_dir):
    """X1, X3, X5, AG6: findings by detector in whole texts; the SQL knows only the secrets written behind them."""
    rows = derived.secret_texts(spark, sf_dir)
    return redact.report(redact.findings(redact.redact(rows)))


@query(f"""
SELECT history_id, CASE d % 6
    WHEN 0 THEN regexp_replace(content, 'sk-[0-9a-f]+', repeat('*', 35)) WHEN 1 THEN regexp_replace(content, 'ghp_[0-9a-f]+', repeat('*', 36))
    WHEN 2 THEN regexp_replace(content, 'AKIA[0-9A-F]+', repeat('*', 20)) WHEN 3 THEN regexp_replace(content, ': [0-9a-f]+', ': ' || repeat('*', 12))
    WHEN 4 THEN regexp_replace(content, 'Bearer [0-9a-f]+', 'Bearer ' || repeat('*', 32)) ELSE regexp_replace(content, '//[^@]*@', '//' || repeat('*', CAST(10 + length(CAST(d AS VARCHAR)) AS BIGINT)) || '@') END AS content
FROM (SELECT *, CAST(substr(history_id, 2) AS BIGINT) AS d FROM ({derived.SECRETS}) s)
""")
def redact_masked(spark, sf_dir):
    """Masked contents keep their length."""
    return redact.redact(derived.secrets(spark, sf_dir)).select("history_id", "content")


@query()
def redact_texts(spark, sf_dir):
    """Whole texts masked; SQL cannot tell a text's own findings."""
    return redact.redact(derived.secret_texts(spark, sf_dir)).select("history_id", "content")


# ---- archive ----

_REC = "sha256(" + " || ".join(f"coalesce(length({x}) || ':' || {x}, '-1:')" for x in ("source_id", "CAST(sequence AS VARCHAR)", "role", "content")) + " || '-1:' || '2:{}')"


@query(f"""
WITH RECURSIVE r AS (
  SELECT history_id, row_number() OVER (PARTITION BY history_id ORDER BY sequence, source_id) - 1 AS pos, {_REC} AS rec FROM ({derived.CONVERSATIONS}) c
), walk AS (
  SELECT history_id, pos, sha256('0:' || repeat('0', 64) || ':' || rec) AS head FROM r WHERE pos = 0
  UNION ALL
  SELECT r.history_id, r.pos, sha256(CAST(r.pos AS VARCHAR) || ':' || w.head || ':' || r.rec) FROM walk w JOIN r ON r.history_id = w.history_id AND r.pos = w.pos + 1
)
SELECT history_id, max_by(head, pos) AS head, count(*) AS n_entries FROM walk GROUP BY history_id
""")
def archive_chain(spark, sf_dir):
    """A2: heads of the hash chains of all conversations."""
    return archive.chain(derived.conversations(spark, sf_dir)).select("history_id", "head", F.size("entries").cast("bigint").alias("n_entries"))


@query("""
SELECT code, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'entry' AS code, count(*) AS n FROM conversations WHERE conv_id % 5 = 0 AND turn % 2 = 1
) GROUP BY code HAVING sum(n) > 0
""")
def archive_verify(spark, sf_dir):
    """A5: contents changed behind the archive's back."""
    kept = archive.archived(derived.conversations(spark, sf_dir))
    hit = (F.substring("history_id", 2, 20).cast("bigint") % 5 == 0) & (F.col("sequence") % 2 == 1)
    bent = kept.withColumn("content", F.when(hit, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return archive.verify(bent).groupBy("code").agg(F.count("*").alias("n"))


@query(f"SELECT history_id, count(*) AS n_new FROM ({derived.CONVERSATIONS}) c WHERE sequence >= 2 GROUP BY history_id")
def archive_append(spark, sf_dir):
    """Redelivered turns are left out, new ones stay."""
    rows = derived.conversations(spark, sf_dir)
    return archive.append(rows.where("sequence < 2"), rows).groupBy("history_id").agg(F.count("*").alias("n_new"))


@query(f"""
SELECT history_id, source_id, substr(content, 3, 8) AS quote FROM ({derived.CONVERSATIONS}) c WHERE length(content) >= 10
""")
def archive_resolve(spark, sf_dir):
    """Spans read back from their records."""
    rows = derived.conversations(spark, sf_dir)
    spans = rows.select("history_id", "source_id", F.lit(2).alias("start"), F.lit(10).alias("end"))
    return archive.resolve_spans(spans, rows).where("quote is not null").select("history_id", "source_id", "quote")


# ---- reports ----


@query(f"""
SELECT change, count(*) AS n FROM (
  SELECT CASE WHEN sequence % 4 = 0 THEN 'added' WHEN sequence % 4 = 1 THEN 'removed' WHEN sequence % 4 = 2 THEN 'modified' ELSE 'shared' END AS change
  FROM ({derived.CONVERSATIONS}) c) GROUP BY change
""")
def artifact_diff(spark, sf_dir):
    """Two snapshots compared."""
    rows = derived.conversations(spark, sf_dir).select("history_id", F.col("source_id").alias("id"), F.col("content").alias("text"), F.col("role").alias("kind"), "sequence")
    before = rows.where("sequence % 4 <> 0")
    after = rows.where("sequence % 4 <> 1").withColumn("text", F.when(F.col("sequence") % 4 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return report.diff(before, after).groupBy("change").agg(F.count("*").alias("n"))


@query(f"""
SELECT history_id, count(*) AS items, count(*) FILTER (kind IN ('goal', 'constraint', 'unresolved', 'exact_error', 'exact_reference')) AS protected,
       count(*) FILTER (kind IN ('exact_error', 'exact_reference')) AS exact
FROM ({derived.EXPECTED}) e GROUP BY history_id
""")
def ledger_metrics(spark, sf_dir):
    """AG3: counters per history."""
    return report.metrics(order_items(spark, sf_dir)).select("history_id", "items", "protected", "exact")


@query(f"""
SELECT history_id, sha256(string_agg(CAST(sequence AS VARCHAR) || ':' || source_id || ':' || {_REC}, ';' ORDER BY sequence, source_id)) AS source_digest, count(*) AS source_count
FROM ({derived.CONVERSATIONS}) c GROUP BY history_id
""")
def source_digest(spark, sf_dir):
    """Digests of ordered sources."""
    return report.source_digest(derived.conversations(spark, sf_dir))


# ---- evaluation ----


@query("""
SELECT source AS grp, CAST(sum(least(e, p)) AS BIGINT) AS tp, CAST(sum(p - least(e, p)) AS BIGINT) AS fp, CAST(sum(e - least(e, p)) AS BIGINT) AS fn FROM (
  SELECT source, lang, count(*) FILTER (doc_id % 3 <> 0) AS e, count(*) FILTER (doc_id % 2 = 0) AS p FROM documents GROUP BY source, lang) GROUP BY source
""")
def prf_by_group(spark, sf_dir):
    """AG9, U5: multiset hits and misses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("grp"), "lang")
    return evaluate.prf(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 2 = 0"), ["grp", "lang"], "grp").select("grp", "tp", "fp", "fn")


@query("""
SELECT source, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM (
  SELECT source, CASE WHEN doc_id % 7 = 0 THEN 'test' WHEN doc_id % 7 = 1 THEN 'development' ELSE 'train' END AS split FROM documents) GROUP BY source HAVING count(DISTINCT split) > 1
""")
def split_leakage(spark, sf_dir):
    """AG13: sources in more than one split."""
    split = F.when(F.col("doc_id") % 7 == 0, "test").when(F.col("doc_id") % 7 == 1, "development").otherwise("train")
    return evaluate.leakage(table(spark, sf_dir, "documents").select("source", split.alias("split")), "source")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey AS id, o_orderkey % 100 AS a, o_orderkey % 100 + 10 AS b FROM orders)
SELECT l.o_custkey AS custkey, count(*) AS n FROM s l JOIN s r ON l.o_custkey = r.o_custkey AND l.a < r.b AND r.a < l.b WHERE l.id % 2 = 0 AND r.id % 2 = 1 GROUP BY l.o_custkey
""")
def span_overlaps(spark, sf_dir):
    """Overlapping intervals by buckets."""
    s = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("history_id"), F.lit("s").alias("source_id"), F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") % 100).cast("int").alias("start"), (F.col("o_orderkey") % 100 + 10).cast("int").alias("end"),
    )
    met = evaluate.overlaps(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 16)
    return met.groupBy(F.col("history_id").cast("bigint").alias("custkey")).agg(F.count("*").alias("n"))


@query("""
SELECT history_id, token, count(DISTINCT source_id) AS df FROM (
  SELECT 'p' || p_size AS history_id, 'k' || p_partkey AS source_id, unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS token FROM part
) WHERE length(token) > 1 AND token NOT IN ('in', 'it', 'is', 'the', 'a', 'an', 'and', 'of', 'on', 'or', 'to') GROUP BY history_id, token
""")
def token_document_frequency(spark, sf_dir):
    """R2, AG12: in how many records of a group a token occurs."""
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("history_id"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("source_id"),
        F.regexp_replace("p_name", "[^A-Za-z]+", " ").alias("content"),
    )
    return evaluate.rarity(rows).select("history_id", "token", "df")


@query("""
SELECT avg(value) AS mean, median(value) AS median, quantile_disc(value, 0.95) AS p95 FROM (SELECT CAST(CAST(value * 100 AS BIGINT) AS DOUBLE) AS value FROM events)
""")
def latency_summary(spark, sf_dir):
    """AG10: mean, median, nearest-rank percentile."""
    rows = table(spark, sf_dir, "events").select(F.expr("CAST(round(value * 100) AS BIGINT)").cast("double").alias("value"))
    return evaluate.latency(rows, "value")


@query("SELECT event_type AS content, count(*) AS n FROM events GROUP BY event_type")
def stream_ingest(spark, sf_dir):
    """ST1: events as records in a stream, redelivered once."""
    run = f"{shared_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("history_id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_id"),
        F.col("event_id").alias("sequence"), F.lit("tool").alias("role"), F.col("event_type").alias("content"),
    )
    rows.where("event_id % 2 = 0").write.parquet(f"{run}/in/a")
    rows.write.parquet(f"{run}/in/b")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{run}/in/*")
    ingest.ingest(stream, f"{run}/table", f"{run}/state").awaitTermination()
    return ingest.stored(spark, f"{run}/table", rows.schema).groupBy("content").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    from . import bounds, checked, live  # noqa: F401  register more of them

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import bounds, checked, live  # noqa: F401

    return dict(SQL)
