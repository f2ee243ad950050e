"""Scalar functions: text, dates, numbers, hashes, and information extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from ..operators import rules as R
from ..operators import search as S
from ..sources.shapes import calendar, messages, micros, table
from .base import query

_FOLD = "trim(regexp_replace(replace(lower(strip_accents({})), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def c1_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalise(F.col("text")).cast("binary")).alias("folded"))


@query(f"SELECT doc_id, contains(' ' || {_FOLD.format('text')} || ' ', ' the ') AS hit FROM documents")
def c2_whole_word(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.has_words(T.normalise(F.col("text")), F.lit("the")).alias("hit"))


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"""
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"


@query(f"SELECT page_id, length(trim(regexp_replace({_HTML}, '\\s+', ' ', 'g'))) AS n, md5(trim(regexp_replace({_HTML}, '\\s+', ' ', 'g'))) AS text FROM pages")
def c3_strip_html(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("text"))


@query(r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM documents")
def c4_white_space(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(T.flat(F.col("text"))).alias("n"))


@query(r"""WITH t AS (SELECT doc_id, chr(10) || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'On Monday 3 May, Kim Doe wrote:' || chr(10) || '> old' WHEN doc_id % 3 = 1 THEN chr(10) || '-- ' || chr(10) || 'Kim' ELSE '' END AS t FROM documents),
q AS (SELECT doc_id, t, nullif(regexp_extract(t, '\n(On [^\n]{3,80} wrote:|-{3,} ?Original Message|>)'), '') AS mark FROM t),
h AS (SELECT doc_id, CASE WHEN mark IS NULL THEN t ELSE substr(t, 1, strpos(t, mark)) END AS h FROM q),
s AS (SELECT doc_id, h, nullif(regexp_extract(h || chr(10), '\n-- ?\n'), '') AS mark FROM h),
b AS (SELECT doc_id, CASE WHEN strpos(h || chr(10), mark) > 40 THEN substr(h, 1, strpos(h || chr(10), mark)) ELSE h END AS b FROM s)
SELECT doc_id, md5(regexp_replace(b, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')) AS cleaned FROM b""")
def c5_clean_mail(spark: SparkSession, d: str) -> DataFrame:
    tail = F.expr(r"CASE WHEN doc_id % 3 = 0 THEN '\nOn Monday 3 May, Kim Doe wrote:\n> old' WHEN doc_id % 3 = 1 THEN '\n-- \nKim' ELSE '' END")
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_mail(F.concat("text", tail)).cast("binary")).alias("cleaned"))


_MAIL = r"""text || chr(10) || CASE doc_id % 5 WHEN 0 THEN 'On Monday 3 May, Kim Doe wrote:' || chr(10) || '> old' WHEN 1 THEN '-- ' || chr(10) || 'Kim' WHEN 2 THEN 'Click to unsubscribe from ' || source WHEN 3 THEN '> quoted' || chr(10) || 'see https://x.example.com/track/' || doc_id || ' now' ELSE 'Sent from my iPhone' END"""
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TIDY = _TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '[\x{{200B}}\x{{00AD}}]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


_FOOT = tuple(rf".{{0,120}}\b{x}\b.{{0,200}}" for x in T.FOOTERS)


def _before(c: str, patterns: tuple[str, ...], least: str = "0") -> str:
    at = f"strpos({c}, nullif(regexp_extract({c}, '(?im)^(?:{'|'.join(patterns)})$'), ''))"
    return f"CASE WHEN {at} > 0 AND {at} - 1 >= {least} THEN substr({c}, 1, {at} - 1) ELSE {c} END"


@query(rf"""WITH t AS (SELECT doc_id, {_TIDY.format(_MAIL)} AS a FROM documents),
b AS (SELECT doc_id, regexp_replace({_before("a", T.QUOTES)}, '(?m)^[ \t]*>.*(?:\n|\z)', '', 'g') AS b FROM t),
c AS (SELECT doc_id, {_before("b", T.SIGNATURES)} AS c FROM b),
d AS (SELECT doc_id, {_before("c", _FOOT, 'greatest(80, floor(length(c) * 0.55))')} AS d FROM c),
e AS (SELECT doc_id, {_TIDY.format(f"regexp_replace(d, '(?i)https?://[^[:space:]]*?(?:{'|'.join(T.TRACKERS)})[^[:space:]]*', '', 'g')")} AS e FROM d)
SELECT doc_id, md5(CASE WHEN length(e) > 40000 THEN regexp_replace(substr(e, 1, 40000), ' [^ ]*\z', '') || ' ...' ELSE e END) AS cleaned FROM e""")
def c6_ingested_mail(spark: SparkSession, d: str) -> DataFrame:
    """Documents as mails with a quoted thread, a signature, a footer, a tracking link or a phone's line, without all that."""
    tail = F.expr(r"CASE doc_id % 5 WHEN 0 THEN 'On Monday 3 May, Kim Doe wrote:\n> old' WHEN 1 THEN '-- \nKim' WHEN 2 THEN concat('Click to unsubscribe from ', source) WHEN 3 THEN concat('> quoted\nsee https://x.example.com/track/', doc_id, ' now') ELSE 'Sent from my iPhone' END")
    mail = F.concat("text", F.lit("\n"), tail)
    return table(spark, d, "documents").select("doc_id", F.md5(T.ingested_mail(mail).cast("binary")).alias("cleaned"))


@query()
def c7_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = T.chunks(table(spark, d, "documents"), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"))


@query("SELECT file_id, lower(regexp_replace(regexp_replace(regexp_replace('Budget' || file_id || 'Report_final-v' || file_id || '.docx', '\\.[A-Za-z0-9]{1,5}$', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-.]+', ' ', 'g')) AS words FROM files")
def c8_file_words(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("Budget"), "doc_id", F.lit("Report_final-v"), "doc_id", F.lit(".docx"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), T.file_words(name).alias("words"))


@query("SELECT message_id, concat_ws(chr(10), nullif(trim(subject), ''), from_email, nullif(trim(body), '')) AS t FROM messages")
def c9_embed_text(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return messages(spark, d).select("message_id", F.concat_ws("\n", some("subject"), "from_email", some("body")).alias("t"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN rtrim(substr(text, 1, 59)) || '…' ELSE text END AS t FROM documents WHERE lang = 'es'")
def c10_clip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'es'").select("doc_id", T.clip(F.col("text"), 60).alias("t"))


@query(f"SELECT doc_id, len(list_filter(list_distinct(string_split({_FOLD.format('text')}, ' ')), lambda w: length(w) > 1 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}))) AS n FROM documents")
def c11_topic_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.topic_words(F.col("text"))).alias("n"))


@query("SELECT p_partkey, len(string_split(trim(p_name), ' ')) >= 2 OR regexp_matches(p_name, '[0-9]') AS exact FROM part")
def c13_identifier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.identifier(F.col("p_name")).alias("exact"))


@query("SELECT c_custkey, round(c_acctbal, 2) AS comma, round(c_acctbal, 2) AS dot FROM customer")
def c17_clean_number(spark: SparkSession, d: str) -> DataFrame:
    dot = F.format_number("c_acctbal", 2)
    comma = F.translate(dot, ",.", ".,")
    return table(spark, d, "customer").select("c_custkey", T.number(comma).alias("comma"), T.number(dot).alias("dot"))


@query("""WITH s AS (SELECT file_id, size_bytes * (1024 ** (file_id % 4))::BIGINT AS n FROM files)
SELECT file_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 102.4) / 10) WHEN n < 1073741824 THEN printf('%.1f MB', floor(n / 104857.6) / 10) ELSE printf('%.1f GB', floor(n / 107374182.4) / 10) END AS size FROM s""")
def c20_size_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars") * F.pow(F.lit(1024), F.col("doc_id") % 4).cast("long")
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), T.size_text(n).alias("size"))


@query("SELECT event_id, epoch_us(date_trunc('month', ts)) AS month, epoch_us(date_trunc('week', ts)) AS week, epoch_us(date_trunc('quarter', ts)) AS quarter, epoch_us(date_trunc('day', ts)) + 86400000000 AS day_end FROM events")
def c24_calendar_starts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    start = lambda unit: micros(F.date_trunc(unit, "ts"))
    return e.select("event_id", start("month").alias("month"), start("week").alias("week"), start("quarter").alias("quarter"), (start("day") + 86_400_000_000).alias("day_end"))


@query("SELECT event_id, greatest(0, round_even((ends_us - starts_us) / 60000000.0, 0)) AS minutes FROM calendar")
def c25_duration(spark: SparkSession, d: str) -> DataFrame:
    return calendar(spark, d).select("event_id", F.greatest(F.lit(0.0), F.bround((F.col("ends_us") - F.col("starts_us")) / 60_000_000.0, 0)).alias("minutes"))


@query("SELECT event_id, strftime((ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M') AS label FROM events")
def c27_local_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format(F.from_utc_timestamp("ts", "America/New_York"), "yyyy-MM-dd HH:mm").alias("label"))


@query("SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' min' WHEN s < 86400 THEN s // 3600 || ' h' ELSE s // 86400 || ' d' END AS lag FROM (SELECT event_id, (1706659200000000 - starts_us) // 1000000 AS s FROM calendar)")
def c28_lag_in_words(spark: SparkSession, d: str) -> DataFrame:
    s = F.floor((F.lit(1_706_659_200_000_000) - F.col("starts_us")) / 1_000_000)
    part = lambda n, unit: F.format_string(f"%d {unit}", F.floor(s / n))
    return calendar(spark, d).select("event_id", F.when(s < 60, "just now").when(s < 3600, part(60, "min")).when(s < 86_400, part(3600, "h")).otherwise(part(86_400, "d")).alias("lag"))


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(greatest(0, least(1, (list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) - 0.2) / 0.65)), 6) AS cn FROM embeddings, q")
def c33_linear_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(S.linear_confidence(S.cosine_to("embedding", S.query_vector(spark, d))), 6).alias("cn"))


@query("SELECT conv_id, list(role ORDER BY turn)[1] AS first, list(role ORDER BY turn)[-1] AS last, array_to_string(list_filter(list(role ORDER BY turn), lambda x: x <> 'user'), ', ') AS excluded, count(*) AS n FROM conversations GROUP BY conv_id")
def c36_list_filters(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return c.select("conv_id", F.element_at("r", 1).alias("first"), F.element_at("r", -1).alias("last"), F.array_join(F.filter("r", lambda x: x != "user"), ", ").alias("excluded"), F.size("r").alias("n"))


_NS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query(f"""WITH h AS (SELECT doc_id, sha1(from_hex('{_NS.replace('-', '')}') || encode('doc:' || doc_id)) AS s FROM documents)
SELECT doc_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || lower(to_hex((('0x' || substr(s, 17, 2))::INT & 63) | 128)) || substr(s, 19, 2) || '-' || substr(s, 21, 12) AS id FROM h""")
def c40_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fingerprint(F.concat(F.lit("doc:"), "doc_id"), _NS).alias("id"))


@query("SELECT message_id, md5(subject || chr(31) || body || chr(31) || from_email) AS hash FROM messages")
def c41_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("message_id", F.md5(F.concat_ws(chr(31), "subject", "body", "from_email").cast("binary")).alias("hash"))


@query("""WITH r(priority, reason, status_from, status_upto, class) AS (VALUES (1, 'error', NULL, NULL, 'quota'), (2, 'refund', 50, NULL, 'auth'), (3, NULL, 10, 40, 'transient'), (4, NULL, 90, NULL, 'server'), (5, 'click', NULL, 5, 'not_found'))
SELECT event_id, coalesce((SELECT min_by(class, priority) FROM r WHERE (r.reason IS NULL OR r.reason = title) AND (status_from IS NULL OR k >= status_from) AND (status_upto IS NULL OR k < status_upto)), 'other') AS class, least(2 * power(2, k % 8), 60) AS wait FROM calendar""")
def c44_error_class_and_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Classes of errors by reason first and status then, from a table of rules; the wait before the next try."""
    c = calendar(spark, d).select("event_id", F.col("title").alias("reason"), F.col("k").alias("status"))
    rules = [(1, "error", None, None, "quota"), (2, "refund", 50, None, "auth"), (3, None, 10, 40, "transient"), (4, None, 90, None, "server"), (5, "click", None, 5, "not_found")]
    out = R.decide(c, spark.createDataFrame(rules, "priority int, reason string, status_from int, status_upto int, class string"), ["event_id"], "class", "other")
    return out.select("event_id", "class", F.least(2 * F.pow(F.lit(2), F.col("status") % 8), F.lit(60.0)).alias("wait"))


@query("SELECT p_partkey, price FROM (SELECT p_partkey, price, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS r FROM part JOIN (VALUES ('Brand', 1), ('Brand#1', 2), ('Brand#12', 3), ('Brand#3', 4)) m(prefix, price) ON starts_with(p_brand, prefix)) WHERE r = 1")
def c46_longest_prefix_price(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame([("Brand", 1), ("Brand#1", 2), ("Brand#12", 3), ("Brand#3", 4)], "prefix string, price int")
    # prefixes of every length meet the table by equality, however large it is
    p = table(spark, d, "part").select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.length("p_brand")), lambda n: F.substring("p_brand", F.lit(1), n))).alias("prefix"))
    return p.join(m, "prefix").groupBy("p_partkey").agg(F.max_by("price", F.length("prefix")).alias("price"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x)))), ',') AS emails FROM documents WHERE contains(text, '@')")
def x3_emails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").contains("@")).select("doc_id", F.array_join(F.array_sort(T.emails(F.col("text"))), ",").alias("emails"))


@query(r"""SELECT page_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(html || ' ' || url, 'https?://\S+'), lambda x: regexp_replace(regexp_extract(x, '[^<>"]+'), '[\]).,;:!?'']+$', '')), lambda x: NOT ends_with(x, '/') OR length(x) > 8))) AS n FROM pages""")
def x4_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.size(T.urls(F.concat("html", F.lit(" "), "url"))).alias("n"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '(?:\+|\()?\d+(?:\)? |\)|[. -]\(?)\d+(?:[. -]\d+)+'), lambda x: length(regexp_replace(x, '\D', '', 'g')) BETWEEN 9 AND 15))), ',') AS phones FROM documents WHERE regexp_matches(text, '\d{3}')")
def x9_phones(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").rlike(r"\d{3}")).select("doc_id", F.array_join(F.array_sort(T.phones(F.col("text"))), ",").alias("phones"))


@query()
def x14_claimed_spans(spark: SparkSession, d: str) -> DataFrame:
    """All that the rules find in documents and pages; no two spans of a text overlap."""
    texts = [table(spark, d, t).select(F.lit(t).alias("source"), F.col(k).alias("id"), F.col(c).alias("text")) for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"))]
    both = texts[0].unionAll(texts[1]).select(F.struct("source", "id").alias("key"), "text")
    return spans.claimed(both, "key", "text").select("key.source", "key.id", "spans")
