"""Joins: full outer, semi, anti, range, nearest, lookups, and the interval operators built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import search as S
from ..sources.scratch import stored
from ..sources.shapes import at, calendar, table
from .base import query
from .retrieval import LEX_SQL, VEC_SQL

JAN8 = 1_704_672_000_000_000


@query(f"WITH {VEC_SQL}, {LEX_SQL} SELECT coalesce(v.id, l.id) AS id, round(coalesce(v.cosine, 0), 6) AS cosine, round(coalesce(l.score, 0), 6) AS lexical FROM vec v FULL JOIN lex l ON v.id = l.id")
def j1_full_outer(spark: SparkSession, d: str) -> DataFrame:
    v, x = S.arms(spark, d)
    return v.join(x, "id", "full").select("id", F.round(F.coalesce("cosine", F.lit(0.0)), 6).alias("cosine"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("lexical"))


@query(f"WITH {LEX_SQL} SELECT l.id, d.source, d.n_chars FROM lex l JOIN documents d ON d.doc_id = l.id")
def j2_late_materialise(spark: SparkSession, d: str) -> DataFrame:
    _, x = S.arms(spark, d)
    return x.select("id").join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars"), "id")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' GROUP BY c_mktsegment")
def j4_inner_filter(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return o.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_orderpriority")
def j5_join_then_count(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    return lines.join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").groupBy("o_orderpriority").agg(F.sum("k").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j7_semi(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j8_anti(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left_anti")


@query("""WITH known AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN md5(text) ELSE 'old' END AS hash FROM documents WHERE doc_id % 4 <> 0)
SELECT d.doc_id, md5(d.text) IS DISTINCT FROM k.hash AS changed FROM documents d LEFT JOIN known k ON k.doc_id = d.doc_id""")
def j9_changed_by_hash(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    known = now.where("doc_id % 4 <> 0").select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN hash ELSE 'old' END").alias("old"))
    return now.join(known, "doc_id", "left").select("doc_id", (~F.col("hash").eqNullSafe(F.col("old"))).alias("changed"))


def _busy(spark: SparkSession, d: str, title: str) -> DataFrame:
    return calendar(spark, d).where(F.col("title") == title).select(F.col("calendar_id").alias("who"), "event_id", F.col("starts_us").alias("start"), F.col("ends_us").alias("end"))


@query("""SELECT a.event_id AS purchase, b.event_id AS error, (least(a.ends_us, b.ends_us) - greatest(a.starts_us, b.starts_us)) // 60000000 AS minutes
FROM calendar a JOIN calendar b ON a.calendar_id = b.calendar_id AND a.starts_us < b.ends_us AND b.starts_us < a.ends_us WHERE a.title = 'purchase' AND b.title = 'error'""")
def j10_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    b = _busy(spark, d, "error").select("who", F.col("event_id").alias("error"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return I.overlap_join(_busy(spark, d, "purchase"), b, ["who"]).select(F.col("event_id").alias("purchase"), "error", I.overlap_minutes().alias("minutes"))


@query("""SELECT a.event_id AS one, b.event_id AS other, (least(a.ends_us, b.ends_us) - greatest(a.starts_us, b.starts_us)) // 60000000 AS minutes
FROM calendar a JOIN calendar b ON a.calendar_id = b.calendar_id AND a.event_id <> b.event_id AND a.starts_us < b.ends_us AND b.starts_us < a.ends_us WHERE a.title = 'click' AND b.title = 'click'""")
def j11_double_booking(spark: SparkSession, d: str) -> DataFrame:
    a = _busy(spark, d, "click")
    b = a.select("who", F.col("event_id").alias("other"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return I.overlap_join(a, b, ["who"]).where("event_id <> other").select(F.col("event_id").alias("one"), "other", I.overlap_minutes().alias("minutes"))


@query("""SELECT pin, other, apart FROM (SELECT a.event_id AS pin, b.event_id AS other, abs(a.starts_us - b.starts_us) AS apart, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.starts_us - b.starts_us), b.event_id) AS r
FROM calendar a JOIN calendar b ON a.calendar_id = b.calendar_id AND abs(a.starts_us - b.starts_us) <= 7200000000 WHERE a.title = 'purchase' AND b.title = 'signup') WHERE r = 1""")
def j13_nearest(spark: SparkSession, d: str) -> DataFrame:
    pins = _busy(spark, d, "purchase").select("who", F.col("event_id").alias("pin"), F.col("start").alias("pin_at"))
    others = _busy(spark, d, "signup").select("who", F.col("event_id").alias("other"), F.col("start").alias("other_at"))
    return I.nearest(pins, others, ["who"], 7_200_000_000)


@query("""WITH anchor AS (SELECT conv_id, min(turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT c.conv_id, c.turn FROM conversations c JOIN anchor a ON a.conv_id = c.conv_id AND c.turn > a.t""")
def j15_replies_after_anchor(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    anchor = stored(c.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("t")), "anchor")
    return c.join(anchor, "conv_id").where("turn > t").select("conv_id", "turn")


@query("""SELECT l.doc_id, coalesce(a.quality, b.quality) AS grade FROM (SELECT doc_id, n_chars FROM documents) l LEFT JOIN (SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 0) a ON a.doc_id = l.doc_id
LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) b ON b.doc_id = l.doc_id""")
def j16_lookup_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "labels")
    a = g.where("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("qa"))
    b = g.groupBy("doc_id").agg(F.min("quality").alias("qb"))
    return table(spark, d, "documents").select("doc_id").join(a, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", F.coalesce("qa", "qb").alias("grade"))


_HOSTS = "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages"


@query(f"WITH h AS ({_HOSTS}), g(suffix, brand) AS (VALUES ('example.com', 'com'), ('example.net', 'net'), ('example.org', 'org')) SELECT page_id, brand FROM h JOIN g ON host = suffix OR ends_with(host, '.' || suffix)")
def j17_domain_suffix(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([("example.com", "com"), ("example.net", "net"), ("example.org", "org")], "suffix string, brand string")
    hosts = table(spark, d, "pages").select("page_id", F.split(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), r"\.").alias("labels"))
    suffixes = hosts.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("suffix"))
    return suffixes.join(groups, "suffix").select("page_id", "brand")


@query("WITH t(token) AS (VALUES ('united states'), ('china'), ('india'), ('the and'), ('and the of'), ('a')), n AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n FROM documents) SELECT doc_id, token FROM n JOIN t ON contains(n, ' ' || token || ' ')")
def j18_tokens_in_text(spark: SparkSession, d: str) -> DataFrame:
    tokens = ["united states", "china", "india", "the and", "and the of", "a"]  # a lexicon, a parameter of known size
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), F.lit(" "))
    held = F.array_compact(F.array(*[F.when(F.col("t").contains(f" {x} "), F.lit(x)) for x in tokens]))
    return table(spark, d, "documents").select("doc_id", text.alias("t")).select("doc_id", F.explode(held).alias("token"))


@query("SELECT message_id FROM messages WHERE thread_id IN (SELECT thread_id FROM messages WHERE from_email = 'system@example.com') AND position = 1")
def j19_star_reference(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.shapes import messages

    m = messages(spark, d)
    step = m.where("from_email = 'system@example.com'").select("thread_id")
    return m.where("position = 1").join(step, "thread_id", "left_semi").select("message_id")


@query("""WITH seen AS (SELECT role AS who, 1 AS w, 'mail' AS src FROM conversations UNION ALL SELECT event_type, 2, 'calendar' FROM events UNION ALL SELECT source, 1, 'drive' FROM documents)
SELECT who, count(*) AS n, sum(w) AS weight, count(DISTINCT src) AS sources FROM seen GROUP BY who""")
def j20_candidates_from_all_sources(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations").select(F.col("role").alias("who"), F.lit(1).alias("w"), F.lit("mail").alias("src"))
    e = table(spark, d, "events").select(F.col("event_type").alias("who"), F.lit(2).alias("w"), F.lit("calendar").alias("src"))
    f = table(spark, d, "documents").select(F.col("source").alias("who"), F.lit(1).alias("w"), F.lit("drive").alias("src"))
    part = m.unionAll(e).unionAll(f).groupBy("who", "src").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    return part.groupBy("who").agg(F.sum("n").alias("n"), F.sum("w").alias("weight"), F.count("*").alias("sources"))


_MERGED = """iv AS (SELECT calendar_id AS who, starts_us AS s, ends_us AS e FROM calendar WHERE title = 'click' AND ends_us > starts_us),
f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY who ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM iv),
g AS (SELECT *, sum(new) OVER (PARTITION BY who ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f),
merged AS (SELECT who, min(s) AS s, max(e) AS e FROM g GROUP BY who, island)"""


@query(f"WITH {_MERGED} SELECT who, s AS start, e AS \"end\" FROM merged")
def w11_interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return I.merge(_busy(spark, d, "click"), ["who"])


@query(f"WITH {_MERGED} SELECT * FROM (SELECT who, lag(e) OVER (PARTITION BY who ORDER BY s) AS free_from, s AS free_until FROM merged) WHERE free_until - free_from >= 900000000")
def w12_gaps(spark: SparkSession, d: str) -> DataFrame:
    return I.gaps(I.merge(_busy(spark, d, "click"), ["who"]), ["who"])


@query(f"""WITH {_MERGED}, days AS (SELECT DISTINCT who, {JAN8} + k * 86400000000 AS day FROM iv, range(14) t(k)),
spans AS (SELECT who, day + 9 * 3600000000 AS a, day + 17 * 3600000000 AS b FROM days WHERE isodow(make_timestamp(day)) < 6),
parts AS (SELECT sp.who, a, b, greatest(a, s) AS f, least(b, e) AS u FROM spans sp JOIN merged m ON m.who = sp.who AND a < e AND s < b UNION ALL SELECT who, a, b, a, a FROM spans UNION ALL SELECT who, a, b, b, b FROM spans),
nx AS (SELECT *, lead(f) OVER (PARTITION BY who, a ORDER BY f, u) AS n FROM parts)
SELECT who, u AS free_from, n AS free_until FROM nx WHERE n - u >= 1800000000""")
def i4_free_slots(spark: SparkSession, d: str) -> DataFrame:
    return I.free_slots(_busy(spark, d, "click"), ["who"], JAN8, 14)


@query("""WITH c AS (SELECT a.event_id, count(b.event_id) AS n, coalesce(sum(CASE WHEN b.event_id IS NOT NULL THEN (least(a.ends_us, b.ends_us) - greatest(a.starts_us, b.starts_us)) // 60000000 END), 0) AS minutes FROM calendar a
LEFT JOIN calendar b ON a.calendar_id = b.calendar_id AND b.title = 'error' AND a.starts_us < b.ends_us AND b.starts_us < a.ends_us WHERE a.title = 'purchase' GROUP BY a.event_id)
SELECT event_id, n, minutes::BIGINT AS minutes, n = 0 AS clear FROM c""")
def i5_find_conflicts(spark: SparkSession, d: str) -> DataFrame:
    a = _busy(spark, d, "purchase")
    b = _busy(spark, d, "error").select("who", F.col("event_id").alias("error"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    hits = I.overlap_join(a, b, ["who"]).groupBy("event_id").agg(F.count("*").alias("n"), F.sum(I.overlap_minutes()).alias("minutes"))
    return a.select("event_id").join(hits, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("minutes", F.lit(0)).alias("minutes"), F.col("n").isNull().alias("clear"))


@query("""SELECT event_id, CASE WHEN k % 3 = 0 THEN starts_us + 3600000000 WHEN ends_us <= starts_us THEN ends_us + 86400000000 ELSE ends_us END AS until_us FROM calendar""")
def i2_range_coercion(spark: SparkSession, d: str) -> DataFrame:
    c = calendar(spark, d).withColumn("e", F.when(F.col("k") % 3 != 0, F.col("ends_us")))
    return c.select("event_id", F.when(F.col("e").isNull(), F.col("starts_us") + 3_600_000_000).when(F.col("e") <= F.col("starts_us"), F.col("e") + I.DAY).otherwise(F.col("e")).alias("until_us"))


@query(f"""SELECT sum(e - s) // 60000000 AS busy_minutes, count(*) AS blocks FROM (WITH {_MERGED} SELECT * FROM merged)""")
def a22_busy_minutes(spark: SparkSession, d: str) -> DataFrame:
    return I.merge(_busy(spark, d, "click"), ["who"]).agg(F.floor(F.sum(F.col("end") - F.col("start")) / I.MINUTE).alias("busy_minutes"), F.count("*").alias("blocks"))


@query("SELECT event_id FROM calendar WHERE starts_us >= 1704844800000000 AND starts_us < 1704844800000000 + 36000000000 AND title <> 'view'")
def j12_clash_window(spark: SparkSession, d: str) -> DataFrame:
    return calendar(spark, d).where((F.col("starts_us") >= 1_704_844_800_000_000) & (F.col("starts_us") < 1_704_880_800_000_000) & (F.col("title") != "view")).select("event_id")


@query("""SELECT o.o_orderkey, max(l.l_shipdate) < TIMESTAMP '1995-06-17' AS expired FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' GROUP BY o.o_orderkey""")
def j6_expiry_of(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey").join(last, "o_orderkey").select("o_orderkey", (F.col("last") < at("1995-06-17")).alias("expired"))


@query("""WITH top AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'signup')
SELECT a.user_id, a.event_id AS anchor, count(b.event_id) AS followed FROM top a LEFT JOIN events b ON b.user_id = a.user_id AND epoch_us(b.ts) > a.t AND epoch_us(b.ts) <= a.t + 86400000000 WHERE a.r = 1 GROUP BY ALL""")
def j14_follow_up(spark: SparkSession, d: str) -> DataFrame:
    e = calendar(spark, d).select(F.col("calendar_id").alias("user_id"), "event_id", "title", "starts_us")
    first = e.where("title = 'signup'").groupBy("user_id").agg(F.min(F.struct("starts_us", "event_id")).alias("a")).select("user_id", F.col("a.event_id").alias("anchor"), F.col("a.starts_us").alias("t"))
    first = stored(first, "first")
    after = e.join(first.select("user_id", "t"), "user_id").where((F.col("starts_us") > F.col("t")) & (F.col("starts_us") <= F.col("t") + I.DAY)).groupBy("user_id").agg(F.count("*").alias("followed"))
    return first.join(after, "user_id", "left").select("user_id", "anchor", F.coalesce("followed", F.lit(0)).alias("followed"))


@query("""SELECT id, n, r FROM (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, row_number() OVER (ORDER BY coalesce(a.n, 0) + coalesce(b.n, 0) DESC, coalesce(a.id, b.id)) AS r
FROM (SELECT c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS id, count(*) AS n FROM supplier GROUP BY 1) b ON a.id = b.id) WHERE r <= 10""")
def j3_full_outer_by_document(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("x"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("y"))
    both = a.join(b, "id", "full").select("id", (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("n"))
    top = both.orderBy(F.desc("n"), "id").limit(10)
    return top.select("id", "n", F.row_number().over(Window.orderBy(F.desc("n"), "id")).alias("r"))
