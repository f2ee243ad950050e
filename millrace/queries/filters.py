"""Scans, filters, projections and the row predicate language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as P
from ..sources.shapes import at, calendar, files, messages, micros, table
from .base import query

DAY = 86_400_000_000
JAN10 = 1_704_844_800_000_000


@query(f"SELECT event_id, starts_us, title FROM calendar WHERE starts_us >= {JAN10} AND starts_us < {JAN10 + DAY} ORDER BY starts_us, event_id LIMIT 50")
def s2_enumerate(spark: SparkSession, d: str) -> DataFrame:
    return P.EVENT.enumerate(calendar(spark, d), 50, since=JAN10, until=JAN10 + DAY).select("event_id", "starts_us", "title")


@query("SELECT message_id, sent_us FROM messages WHERE thread_id = 7 ORDER BY sent_us DESC, message_id LIMIT 20")
def s3_list_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.enumerate(messages(spark, d), 20, thread_id=7).select("message_id", micros("sent_at").alias("sent_us"))


@query("SELECT message_id, position, length(body) AS n FROM messages WHERE message_id = '3-1'")
def s4_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.scan(messages(spark, d), message_ids=["3-1"]).select("message_id", "position", F.length("body").alias("n"))


@query("SELECT event_id, title FROM calendar WHERE event_id IN (1, 5, 77, 400)")
def s5_batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    return P.EVENT.scan(calendar(spark, d), external_ids=[1, 5, 77, 400]).select("event_id", "title")


@query("SELECT message_id, position FROM messages WHERE thread_id = 11 ORDER BY sent_us, message_id LIMIT 20")
def s6_thread_scan(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.scan(messages(spark, d), thread_id=11, chunk_index=0).orderBy("sent_at", "message_id").limit(20).select("message_id", "position")


@query("SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL ORDER BY d.n_chars, d.doc_id LIMIT 100")
def s7_rows_needing_embedding(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id", "n_chars").join(known, "doc_id", "left_anti").orderBy("n_chars", "doc_id").limit(100).select("doc_id")


@query("SELECT vec_id FROM embeddings WHERE CASE WHEN label < 9 THEN 'm' || label END IS DISTINCT FROM 'm3' AND vec_id > 100 ORDER BY vec_id LIMIT 64")
def s8_stale_model_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") < 9, F.concat(F.lit("m"), "label")).alias("model"))
    return e.where(~F.col("model").eqNullSafe("m3") & (F.col("vec_id") > 100)).orderBy("vec_id").limit(64).select("vec_id")


@query(f"SELECT title, count(*) AS n FROM calendar WHERE starts_us >= {JAN10} AND starts_us < {JAN10 + 3 * DAY} GROUP BY title")
def f1_half_open_window(spark: SparkSession, d: str) -> DataFrame:
    return P.EVENT.scan(calendar(spark, d), since=JAN10, until=JAN10 + 3 * DAY).groupBy("title").agg(F.count("*").alias("n"))


@query("SELECT mime_type, count(*) AS n FROM files WHERE mime_type IN ('text/en', 'text/de') GROUP BY mime_type")
def f2_any_of(spark: SparkSession, d: str) -> DataFrame:
    return P.FILE.scan(files(spark, d), mime_types=["text/en", "text/de"]).groupBy("mime_type").agg(F.count("*").alias("n"))


@query("SELECT calendar_id, count(*) AS n FROM calendar WHERE calendar_id = 17 GROUP BY calendar_id")
def f3_container(spark: SparkSession, d: str) -> DataFrame:
    return P.EVENT.scan(calendar(spark, d), container_id=17).groupBy("calendar_id").agg(F.count("*").alias("n"))


@query("SELECT message_id FROM messages WHERE from_email IN ('system@example.com', 'user@example.com')")
def f5_senders(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.scan(messages(spark, d), from_emails=["SYSTEM@example.com", "user@example.com"]).select("message_id")


@query("SELECT message_id FROM messages WHERE list_contains(to_emails, 'assistant@example.com')")
def f6_recipient(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.scan(messages(spark, d), to_email="assistant@example.com").select("message_id")


@query("SELECT thread_id, count(*) AS n FROM messages WHERE list_has_any(list_concat(list_append(to_emails, from_email), cc_emails), ['system@example.com', 'assistant@example.com']) GROUP BY thread_id")
def f7_participants(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.scan(messages(spark, d), participant_emails=["system@example.com", "assistant@example.com"]).groupBy("thread_id").agg(F.count("*").alias("n"))


@query("SELECT message_id FROM messages WHERE subject ILIKE '%the%'")
def f11_contains(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.scan(messages(spark, d), subject_contains="the").select("message_id")


@query("SELECT count(*) AS n, min(event_id) AS first FROM calendar WHERE status IS DISTINCT FROM 'cancelled'")
def f14_not_cancelled(spark: SparkSession, d: str) -> DataFrame:
    return P.EVENT.scan(calendar(spark, d), not_cancelled=True).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(f"SELECT event_id FROM calendar WHERE coalesce(ends_us, starts_us) > {JAN10} AND starts_us < {JAN10 + DAY}")
def f15_ends_after(spark: SparkSession, d: str) -> DataFrame:
    return P.EVENT.scan(calendar(spark, d), ends_after=JAN10, until=JAN10 + DAY).select("event_id")


@query("SELECT folder_path, count(*) AS n FROM files WHERE starts_with(folder_path, '/en/src1') GROUP BY folder_path")
def f17_folder_prefix(spark: SparkSession, d: str) -> DataFrame:
    return P.FILE.scan(files(spark, d), folder_prefix="/en/src1").groupBy("folder_path").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def f20_exclude_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT event_id FROM calendar WHERE coalesce(status, 'confirmed') IN ('confirmed', 'tentative')")
def f25_status_in(spark: SparkSession, d: str) -> DataFrame:
    return P.EVENT.scan(calendar(spark, d), status_in=["confirmed", "tentative"]).select("event_id")


@query("SELECT file_id, contains(lower(name || ' ' || content), 'the') AS hit FROM files")
def f24_text_contains(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("file_id", F.lower(F.concat("name", F.lit(" "), "content")).contains("the").alias("hit"))


@query("SELECT event_id AS ref, title AS label, k FROM calendar WHERE k >= 40")
def f31_project_and_json_path(spark: SparkSession, d: str) -> DataFrame:
    return calendar(spark, d).where("k >= 40").select(F.col("event_id").alias("ref"), F.col("title").alias("label"), "k")


def _tests(spark: SparkSession, d: str, tests: list, mode: str = "all") -> DataFrame:
    return P.where(calendar(spark, d), tests, mode).select("event_id")


@query("SELECT event_id FROM calendar WHERE coalesce(lower(status) = 'confirmed', false)")
def f33_eq_folds(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d, [("status", "eq", " Confirmed ")])


@query("SELECT event_id FROM calendar WHERE status IS DISTINCT FROM 'confirmed'")
def f33_ne_null_is_true(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d, [("status", "ne", "confirmed")])


@query("SELECT event_id FROM calendar WHERE title IN ('click', 'view') AND coalesce(status NOT IN ('cancelled'), true)")
def f34_in_and_not_in(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d, [("title", "in", ["Click", "VIEW"]), ("status", "not_in", ["cancelled"])])


@query("SELECT event_id FROM calendar WHERE contains(title, 'ick') OR contains(lower(coalesce(status, '')), 'cancel')")
def f35_contains_any_mode(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d, [("title", "contains", "ick"), ("status", "icontains", "CANCEL")], "any")


@query("SELECT event_id FROM calendar WHERE starts_with(title, 'p') AND regexp_matches(title, '^pur.*e$')")
def f37_prefix_and_pattern(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d, [("title", "starts_with", "P"), ("title", "matches", "^PUR.*e$")])


@query("SELECT event_id FROM calendar WHERE status IS NULL")
def f39_empty(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d, [("status", "empty", None)])


@query("SELECT event_id FROM calendar WHERE k >= 10 AND k < 20 AND value > 50")
def f40_within_and_gt(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d, [("k", "within", (10, 20)), ("value", "gt", 50)])


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01'")
def f41_before(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderdate") < at("1995-03-01")).select("o_orderkey")


@query("SELECT count(*) FILTER (value <= 20) AS count, count(*) - count(*) FILTER (value <= 20) AS dropped, round(count(*) FILTER (value <= 20) / count(*), 3) AS kept_ratio FROM events")
def f43_kept_ratio(spark: SparkSession, d: str) -> DataFrame:
    df = calendar(spark, d)
    return P.kept_ratio(df, P.where(df, [("value", "lte", 20)]))


@query("SELECT event_id FROM calendar WHERE title = 'signup' AND (SELECT count(*) FROM calendar WHERE status = 'cancelled') > 10")
def f44_gate(spark: SparkSession, d: str) -> DataFrame:
    df = calendar(spark, d)
    gate = P.EVENT.scan(df, status="cancelled").limit(11).agg((F.count("*") > 10).alias("open")).where("open")
    return P.where(df, [("title", "eq", "signup")]).join(gate, F.lit(True), "left_semi").select("event_id")


@query("SELECT message_id FROM messages WHERE tenant = 3 AND connector = 'mail' AND from_email = 'user@example.com'")
def s1_tenant_scan(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.of(messages(spark, d), 3, "mail", from_email="user@example.com").select("message_id")


@query("SELECT message_id FROM messages WHERE list_has_any(list_transform(labels, lambda x: lower(x)), ['starred', 'later'])")
def f9_labels(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.scan(messages(spark, d), labels=["STARRED", "later"]).select("message_id")


@query("SELECT message_id FROM messages WHERE has_attachments AND NOT list_contains(labels, 'UNREAD')")
def f10_attachments_and_read(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.scan(messages(spark, d), has_attachments="yes", is_unread=False).select("message_id")


@query("SELECT event_id FROM calendar WHERE recurring_event_id IN ('r10') OR (organizer_email = 'u7@example.com' AND all_day)")
def f12_organizer_series_all_day(spark: SparkSession, d: str) -> DataFrame:
    c = calendar(spark, d)
    one = P.EVENT.predicate({"recurring_event_id": "r10"})
    return c.where(one | P.EVENT.predicate({"organizer_email": "U7@example.com", "all_day": True})).select("event_id")


@query("SELECT event_id FROM calendar WHERE list_has_any(list_transform(attendee_emails, lambda x: lower(x)), ['u9@example.com', 'u11@example.com'])")
def f13_attendees(spark: SparkSession, d: str) -> DataFrame:
    return P.EVENT.scan(calendar(spark, d), attendee_emails=["u9@example.com", "U11@example.com"]).select("event_id")


@query(f"SELECT file_id FROM files WHERE is_shared AND mime_type IN ('text/fr', 'text/es') AND modified_us >= {1_704_067_200_000_000 + 5 * DAY} AND modified_us < {1_704_067_200_000_000 + 20 * DAY}")
def f16_shared_files_of_a_window(spark: SparkSession, d: str) -> DataFrame:
    begin = 1_704_067_200_000_000
    return P.FILE.scan(files(spark, d), is_shared=True, mime_types=["text/fr", "text/es"], since=begin + 5 * DAY, until=begin + 20 * DAY).select("file_id")


@query(f"SELECT event_id FROM calendar WHERE starts_us >= {JAN10} AND starts_us < {JAN10 + DAY} AND event_id % 2 >= 0 AND all_day = false AND calendar_id IN (1, 2, 3, 4, 5)")
def f18_filters_of_a_plan(spark: SparkSession, d: str) -> DataFrame:
    c = calendar(spark, d).where(F.col("calendar_id").isin(1, 2, 3, 4, 5))
    return P.EVENT.of_plan(c, {"window": {"start": "2024-01-10T00:00:00Z", "end": "2024-01-11"}, "bool:all_day": "no", "connectors[]": "calendar", "status": None}).select("event_id")


@query("SELECT event_id FROM calendar WHERE organizer_email = 'u12@example.com' OR list_has_any(list_transform(attendee_emails, lambda x: lower(x)), ['u12@example.com'])")
def f19_participants(spark: SparkSession, d: str) -> DataFrame:
    return P.EVENT.scan(calendar(spark, d), participants=[" U12@example.com"]).select("event_id")


@query("SELECT vec_id FROM (SELECT vec_id, 0.5 + embedding[1]::DOUBLE AS cn FROM embeddings) WHERE cn >= 0.55")
def f21_least_confidence(spark: SparkSession, d: str) -> DataFrame:
    return P.FILE.scan(table(spark, d, "embeddings").select("vec_id", (0.5 + F.col("embedding")[0].cast("double")).alias("cn")), min_cn=0.55).select("vec_id")


@query("SELECT message_id FROM messages WHERE list_contains(labels, 'UNREAD') AND thread_id % 2 = 0")
def f22_unread(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.of_plan(messages(spark, d).where("thread_id % 2 = 0"), {"bool:is_unread": "true"}).select("message_id")


@query(r"SELECT message_id FROM messages WHERE NOT regexp_matches(body, 'https?://[^<>\s\]).,;:!?''/\x22]')")
def f23_has_link(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.scan(messages(spark, d), has_link=False).select("message_id")


@query("SELECT file_id, 'budget plan' AS rest FROM files WHERE mime_type = 'text/plain' OR mime_type = 'text/de'")
def f26_kind_words(spark: SparkSession, d: str) -> DataFrame:
    rest, kinds = P.kind_words("budget plan texts", {**P.FILE_KINDS, "text": "text/de"})
    return P.FILE.scan(files(spark, d), mime_types=kinds).select("file_id", F.lit(rest).alias("rest"))


@query(f"SELECT 'drive' AS shape, count(*) AS n FROM files WHERE modified_us >= {JAN10 - 90 * DAY} AND modified_us < {JAN10} UNION ALL SELECT 'calendar', count(*) FROM calendar WHERE starts_us >= {JAN10 + DAY} AND starts_us < {JAN10 + 2 * DAY}")
def f29_window_rule(spark: SparkSession, d: str) -> DataFrame:
    window, parts = (JAN10 + DAY, JAN10 + 2 * DAY), []  # now is JAN10: the window lies ahead
    for shape, spec, df in (("drive", P.FILE, files(spark, d)), ("calendar", P.EVENT, calendar(spark, d))):
        a, b = P.window_for(shape, window, JAN10)
        parts.append(spec.scan(df, since=a, until=b).agg(F.lit(shape).alias("shape"), F.count("*").alias("n")).select("shape", "n"))
    return parts[0].unionAll(parts[1])


@query("SELECT message_id FROM messages WHERE list_contains(cc_emails, 'system@example.com') AND NOT list_contains(to_emails, 'user@example.com')")
def f6_cc(spark: SparkSession, d: str) -> DataFrame:
    return P.MESSAGE.scan(messages(spark, d), cc_email="system@example.com").where(~F.array_contains("to_emails", "user@example.com")).select("message_id")


@query("SELECT file_id FROM files WHERE list_has_any(shared_with_emails, ['de@example.com', 'fr@example.com'])")
def f7_shared_with(spark: SparkSession, d: str) -> DataFrame:
    return P.FILE.scan(files(spark, d), participant_emails=["DE@example.com", "fr@example.com"]).select("file_id")
