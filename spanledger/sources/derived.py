"""Histories derived from the relational tables, by SQL that Spark and DuckDB both read.

A customer's orders are a history: each order is a record whose words depend on its key.
EXPECTED lists what each record must yield, stated from the templates and not by extraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"

#: template -> (role, content, expected items as (kind, text expression)); k is the order key.
TEMPLATES = {
    0: ("'user'", f"'constraint: the order limit must be exactly ' || t(k % 7 + 10)", [("constraint", "'the order limit must be exactly ' || t(k % 7 + 10)")]),
    1: ("'user'", f"'goal: ship batch ' || t(k % 5) || {NL} || 'progress: batch ' || t(k) || ' is packed'", [("goal", "'ship batch ' || t(k % 5)"), ("progress", "'batch ' || t(k) || ' is packed'")]),
    2: ("'user'", "'Is the delivery date of lane ' || t(k % 3) || ' known?'", [("unresolved", "'Is the delivery date of lane ' || t(k % 3) || ' known?'")]),
    3: ("'assistant'", "'confirmed: the delivery date of lane ' || t(k % 3) || ' is verified'", [("confirmed_fact", "'confirmed: the delivery date of lane ' || t(k % 3) || ' is verified'")]),
    4: ("'tool'", f"'exit code ' || t(k % 9) || {NL} || 'read src/orders/part' || t(k % 11) || '.sql:' || t(k % 13 + 1)", [("exact_error", "'exit code ' || t(k % 9)"), ("exact_reference", "'src/orders/part' || t(k % 11) || '.sql:' || t(k % 13 + 1)")]),
    5: ("'user'", "'The audit cache must be ' || CASE WHEN k % 2 = 0 THEN 'enabled' ELSE 'disabled' END", [("constraint", "'The audit cache must be ' || CASE WHEN k % 2 = 0 THEN 'enabled' ELSE 'disabled' END")]),
    6: ("'user'", f"'facts:' || {NL} || '- lane ' || t(k % 4) || ' is open' || {NL} || '- tests pass on lane ' || t(k % 4)", [("confirmed_fact", "'lane ' || t(k % 4) || ' is open'"), ("confirmed_fact", "'tests pass on lane ' || t(k % 4)")]),
    7: ("'assistant'", "'We decided to pack by weight; the label printer may be slow'", []),
    8: ("'tool'", "'constraint: never ship on day ' || t(k % 6)", []),
    9: ("'user'", "'Orders must be sealed and labels must be printed; do not skip lane ' || t(k % 3)", [("constraint", "'Orders must be sealed'"), ("constraint", "'labels must be printed'"), ("constraint", "'do not skip lane ' || t(k % 3)")]),
}
# The line as a whole is an open question to the rules (may); its clauses are a decision and a question.
TEMPLATES[7] = (TEMPLATES[7][0], TEMPLATES[7][1], [("decision", "'We decided to pack by weight'"), ("unresolved", "'the label printer may be slow'")])


def _sql(expression: str) -> str:
    """t(x) is a number as text."""
    out, at = "", 0
    while (start := expression.find("t(", at)) >= 0 and (start == 0 or not expression[start - 1].isalnum()):
        depth, stop = 1, start + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(expression[stop], 0)
            stop += 1
        out += expression[at:start] + f"CAST(({expression[start + 2 : stop - 1]}) AS STRING)"
        at = stop
    return out + expression[at:]


def _case(of) -> str:
    return "CASE k % 10 " + " ".join(f"WHEN {n} THEN {_sql(of(n))}" for n in TEMPLATES) + " END"


KEYS = """
SELECT 'c' || CAST(o_custkey AS STRING) AS history_id, 'o' || CAST(o_orderkey AS STRING) AS source_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS sequence, o_orderkey AS k
FROM orders
"""
RECORDS = f"SELECT history_id, source_id, sequence, {_case(lambda n: TEMPLATES[n][0])} AS role, {_case(lambda n: TEMPLATES[n][1])} AS content FROM ({KEYS}) keyed"
EXPECTED = " UNION ALL ".join(
    f"SELECT history_id, source_id, sequence, {TEMPLATES[n][0]} AS role, '{kind}' AS kind, {_sql(text)} AS text FROM ({KEYS}) keyed WHERE k % 10 = {n}"
    for n in TEMPLATES
    for kind, text in TEMPLATES[n][2]
)

#: Conversations as histories, for operators that do not care what the words are.
CONVERSATIONS = "SELECT 'v' || CAST(conv_id AS STRING) AS history_id, 't' || CAST(turn AS STRING) AS source_id, CAST(turn AS BIGINT) AS sequence, role, text AS content FROM conversations"
#: Documents with a secret that belongs to their id written behind.
SECRETS = """
SELECT 'd' || CAST(doc_id AS STRING) AS history_id, 's0' AS source_id, CAST(0 AS BIGINT) AS sequence, 'user' AS role, 'note ' || CAST(doc_id AS STRING) || ' ' ||
  CASE doc_id % 6
    WHEN 0 THEN 'key sk-' || md5(CAST(doc_id AS STRING)) || ' end'
    WHEN 1 THEN 'token ghp_' || md5(CAST(doc_id AS STRING)) || ' end'
    WHEN 2 THEN 'id AKIA' || upper(substr(md5(CAST(doc_id AS STRING)), 1, 16)) || ' end'
    WHEN 3 THEN 'password: ' || substr(md5(CAST(doc_id AS STRING)), 1, 12) || ' end'
    WHEN 4 THEN 'Authorization: Bearer ' || md5(CAST(doc_id AS STRING)) || ' end'
    ELSE 'see https://u' || CAST(doc_id AS STRING) || ':' || substr(md5(CAST(doc_id AS STRING)), 1, 8) || '@host.example/x end'
  END AS content
FROM documents
"""
#: The whole texts of documents with those secrets on a line behind them.
SECRET_TEXTS = SECRETS.replace("'note ' ||", "coalesce(text, '') || coalesce(chr(10) || 'note ' ||").replace("END AS content", "END, '') AS content")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def records(spark: SparkSession, sf_dir: str, sql: str = RECORDS, *tables: str) -> DataFrame:
    """A derived history table with the columns that operators expect."""
    register(spark, sf_dir, *(tables or ("orders",)))
    return spark.sql(f"SELECT *, CAST(NULL AS STRING) AS timestamp, '{{}}' AS metadata, false AS trusted, false AS untrusted FROM ({sql}) r")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, CONVERSATIONS, "conversations")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, SECRETS, "documents")


def secret_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, SECRET_TEXTS, "documents")
