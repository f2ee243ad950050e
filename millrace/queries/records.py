"""Records, layouts and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import filters as P
from ..operators import metrics as M
from ..plans.prepass import services_missing
from ..sources import layout
from ..sources.shapes import calendar, files, messages, table
from .base import query

NOW = 1_706_659_200_000_000


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k, [event_type, 'x'][1] AS first, [user_id, user_id + 1] AS users FROM events")
def c37_dotted_path(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.struct(F.from_json("props", "k int").alias("p"), F.array("event_type", F.lit("x")).alias("t"), F.array(F.struct(F.col("user_id").alias("u")), F.struct((F.col("user_id") + 1).alias("u"))).alias("a")).alias("r"))
    return e.select("event_id", R.at_path("r.p.k").alias("k"), R.at_path("r.t[0]").alias("first"), R.at_path("r.a[*].u").alias("users"))


@query("SELECT event_id, '{\"calendar_id\":' || calendar_id || ',\"status\":' || coalesce('\"' || status || '\"', 'null') || ',\"title\":\"' || title || '\"}' AS json FROM calendar")
def c39_canonical_json(spark: SparkSession, d: str) -> DataFrame:
    return calendar(spark, d).select("event_id", R.canonical_json("title", "calendar_id", "status").alias("json"))


@query("SELECT DISTINCT user_id, ('0x' || substr(md5('sync:' || user_id), 1, 8))::BIGINT % 900 AS slot FROM events")
def c42_smear_slot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id").distinct().select("user_id", R.smear_slot("sync", F.col("user_id")).alias("slot"))


@query("SELECT event_id, title, [attendee_emails[1], '+1'] AS attendee_emails, 1 AS hidden FROM calendar")
def c47_redacted(spark: SparkSession, d: str) -> DataFrame:
    return R.redacted(calendar(spark, d).select("event_id", "title", "attendee_emails", "organizer_email"), ["event_id", "title"], {"attendee_emails": 1})


@query("SELECT message_id, CASE WHEN position = 3 THEN '' ELSE body END AS body, ['a@x.example', 'b@x.example'] AS to_emails, '{\"color\":\"red\",\"position\":' || position || '}' AS attributes FROM messages")
def m2_storage_mapping(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).select("message_id", F.when(F.col("position") != 3, F.col("body")).alias("body"), F.array(F.lit("A@x.example "), F.lit("a@x.example"), F.lit("b@X.example")).alias("to_emails"), "position", F.lit("red").alias("color"))
    return R.stored_message(m, ["message_id", "body", "to_emails"], F.timestamp_micros(F.lit(NOW)))


@query("SELECT tenant, count(*) AS n FROM files GROUP BY tenant")
def a3_count_by_tenant(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy("tenant").agg(F.count("*").alias("n"))


@query(f"SELECT connector, max({NOW} - last) AS worst_us FROM (SELECT connector, calendar_id, max(starts_us) AS last FROM calendar GROUP BY ALL UNION ALL SELECT connector, folder_id, max(modified_us) FROM files GROUP BY ALL) GROUP BY connector".replace("calendar_id, max", "calendar_id::VARCHAR AS own, max").replace("folder_id, max", "folder_id, max"))
def a7_worst_lag(spark: SparkSession, d: str) -> DataFrame:
    last = lambda df, own, at: df.groupBy("connector", F.col(own).cast("string").alias("own")).agg(F.max(at).alias("last"))
    both = last(calendar(spark, d), "calendar_id", "starts_us").unionAll(last(files(spark, d), "folder_id", "modified_us"))
    return both.groupBy("connector").agg(F.max(F.lit(NOW) - F.col("last")).alias("worst_us"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def a20_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ends = e.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return M.percentiles(e, "event_type", "value", 0.5, 0.95, 0.99).join(ends, "event_type")


@query("SELECT file_id FROM files WHERE mime_type = 'text/en' ORDER BY modified_us DESC, connector, file_id LIMIT 20 OFFSET 20")
def t7_page_more(spark: SparkSession, d: str) -> DataFrame:
    return P.FILE.page(files(spark, d), 20, 20, mime_type="text/en").select("file_id")


@query("SELECT id, min(r) AS best FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents UNION ALL SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) FROM embeddings) WHERE r <= 30 GROUP BY id")
def u2_union_of_ranked_lists(spark: SparkSession, d: str) -> DataFrame:
    def ranked(df: DataFrame, key: str, *order: object) -> DataFrame:
        few = df.orderBy(*order, key).limit(30)
        return few.select(F.col(key).alias("id"), F.row_number().over(Window.orderBy(*order, key)).alias("r"))

    both = ranked(table(spark, d, "documents"), "doc_id", F.desc("n_chars")).unionByName(ranked(table(spark, d, "embeddings"), "vec_id", "label"))
    return both.groupBy("id").agg(F.min("r").alias("best"))


@query("SELECT event_type AS service FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY event_type")
def u9_services_not_allowed(spark: SparkSession, d: str) -> DataFrame:
    gone = services_missing(["click", "signup", "view", "error", "click"], ["signup", "purchase"])
    return table(spark, d, "events").where(F.col("event_type").isin(gone)).select(F.col("event_type").alias("service")).distinct()


@query("SELECT conv_id, max_by(role, turn) AS last, max(turn) AS round FROM conversations GROUP BY conv_id")
def w9_latest_round(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last"), F.max("turn").alias("round"))


@query("SELECT calendar_id, '**Signups** (' || count(*) || ')' || chr(10) || string_agg('- ' || event_id || ' ' || k, chr(10) ORDER BY event_id) AS markdown FROM calendar WHERE title = 'signup' GROUP BY calendar_id")
def s20_markdown(spark: SparkSession, d: str) -> DataFrame:
    c = calendar(spark, d).where("title = 'signup'")
    return R.markdown_rows(c, "calendar_id", F.concat("event_id", F.lit(" "), "k"), ["event_id"], "Signups")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'of')) AS b FROM w)
SELECT doc_id, round((a + b) / (1 + ln(n)), 6) AS score FROM c WHERE a > 0 AND b > 0""")
def p5_postings(spark: SparkSession, d: str) -> DataFrame:
    hits = layout.lookup(layout.postings(table(spark, d, "documents"), "doc_id", "text"), ["the", "of"], "doc_id")
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT split_part(op, '.', 1) AS service, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'mail.' ELSE 'drive.' END || event_type AS op FROM events) GROUP BY 1")
def p7_service_of_operator(spark: SparkSession, d: str) -> DataFrame:
    op = F.concat(F.when(F.col("event_type").isin("click", "view"), "mail.").otherwise("drive."), "event_type")
    return layout.with_service(table(spark, d, "events").select(op.alias("op"))).groupBy("service").agg(F.count("*").alias("n"))


@query("SELECT 'mail' AS corpus, count(*) AS n FROM messages UNION ALL SELECT 'calendar', count(*) FROM calendar UNION ALL SELECT 'drive', count(*) FROM files")
def p9_corpora_in_one_plan(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("corpus"), "n")
    return one(messages(spark, d), "mail").unionAll(one(calendar(spark, d), "calendar")).unionAll(one(files(spark, d), "drive"))
