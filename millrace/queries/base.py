"""The registry of queries and of the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = CTES_FOR(sql)
        return f

    return register


#: The shapes in SQL, put in front of the queries that name them.
_SHAPES = {
    "messages": """messages AS (SELECT 'mail' AS connector, conv_id || '-' || turn AS message_id, conv_id AS thread_id, turn AS position, role || '@example.com' AS from_email,
      CASE WHEN role = 'user' THEN ['assistant@example.com'] ELSE ['user@example.com'] END AS to_emails, substr(text, 1, 40) AS subject, text AS body, 1704067200000000 + (conv_id * 3600 + turn * 60) * 1000000 AS sent_us,
      conv_id % 7 AS tenant, list_filter(['INBOX', CASE WHEN turn % 2 = 0 THEN 'UNREAD' END, CASE WHEN conv_id % 5 = 0 THEN 'Starred' END], lambda x: x IS NOT NULL) AS labels, length(text) % 4 = 0 AS has_attachments, CASE WHEN conv_id % 3 = 0 THEN ['system@example.com'] ELSE [] END AS cc_emails FROM conversations)""",
    "calendar": """calendar AS (SELECT 'calendar' AS connector, event_id, user_id AS calendar_id, event_type AS title, epoch_us(ts) AS starts_us, epoch_us(ts) + floor(value * 60)::BIGINT * 1000000 AS ends_us,
      CASE WHEN event_type = 'error' THEN 'cancelled' WHEN event_type <> 'view' THEN 'confirmed' END AS status, (props::JSON ->> 'k')::INT AS k, value,
      user_id % 7 AS tenant, 'u' || user_id || '@example.com' AS organizer_email, ['U' || ((user_id + 1) % 50) || '@Example.com', 'u' || (event_id % 50) || '@example.com'] AS attendee_emails, value < 2 AS all_day, CASE WHEN event_id % 10 = 0 THEN 'r' || (event_id % 70) END AS recurring_event_id FROM events)""",
    "files": """files AS (SELECT 'drive' AS connector, doc_id AS file_id, 'doc_' || doc_id || '.txt' AS name, text AS content, 'text/' || lang AS mime_type, source AS folder_id, '/' || lang || '/' || source AS folder_path, n_chars AS size_bytes,
      doc_id % 7 AS tenant, 1704067200000000 + (doc_id * 7919) % 2592000 * 1000000 AS modified_us, source || '@example.com' AS owner_email, doc_id % 3 = 0 AS is_shared, CASE WHEN doc_id % 3 = 0 THEN [lang || '@example.com', 'user@example.com'] ELSE [] END AS shared_with_emails FROM documents)""",
}


def CTES_FOR(sql: str) -> str:
    import re

    used = [cte for name, cte in _SHAPES.items() if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    head = sql.lstrip()
    recursive = head.upper().startswith("WITH RECURSIVE")
    if head.upper().startswith("WITH"):
        rest = head[len("WITH RECURSIVE") if recursive else len("WITH") :]
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(used)}, {rest}"
    return f"WITH {', '.join(used)} {head}"
