"""Schemas of the tables that operators exchange. Nothing is inferred from data."""

RECORDS = (
    "history_id string, source_id string, sequence bigint, role string, content string, "
    "timestamp string, metadata string, trusted boolean, untrusted boolean"
)
SPAN = "struct<source_id: string, start: int, end: int, quote: string>"
ITEMS = (
    "history_id string, id string, kind string, text string, status string, priority int, confidence double, exact boolean, "
    f"tags array<string>, supersedes array<string>, conflicts_with array<string>, provenance array<{SPAN}>, "
    "sequence bigint, roles array<string>, extractors array<string>"
)
ISSUES = "history_id string, code string, severity string, item_id string, source_id string"
FINDINGS = "history_id string, source_id string, sequence bigint, start int, end int, detector string"
