"""Window functions, orders, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import search as S
from ..operators.selection import greedy_fit, running_totals
from ..sources.scratch import stored
from ..sources.shapes import at, calendar, messages, micros, table
from .base import query


@query("SELECT DISTINCT ON (conv_id) conv_id, turn, length(text) AS n FROM conversations ORDER BY conv_id, length(text) DESC, turn")
def w1_distinct_on(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    best = c.groupBy("conv_id").agg(F.max(F.struct("n", (-F.col("turn")).alias("t"))).alias("b"))  # pre-aggregates, unlike a window
    return best.select("conv_id", (-F.col("b.t")).alias("turn"), F.col("b.n").alias("n"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 5")
def w2_arm_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("rank")).where("rank <= 5")


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS cosine FROM embeddings, q),
a AS (SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY round(cosine, 9) DESC, vec_id) <= 10 THEN cosine END AS cosine FROM c) SELECT vec_id, round(coalesce(cosine, min(cosine) OVER (PARTITION BY label)), 6) AS floored FROM a""")
def w5_pool_minimum(spark: SparkSession, d: str) -> DataFrame:
    """Each label's ten best by cosine keep it; the others, which an arm of ten has missed, have the arm's least."""
    e = table(spark, d, "embeddings").select("vec_id", "label", S.cosine_to("embedding", S.query_vector(spark, d)).alias("cosine"))
    w = Window.partitionBy("label").orderBy(F.round("cosine", 9).desc(), "vec_id")
    arm = e.withColumn("r", F.row_number().over(w)).where("r <= 10").select("vec_id", "label", "cosine")
    pool = e.select("vec_id", "label").join(arm.select("vec_id", "cosine"), "vec_id", "left")
    return S.with_floor(pool, "cosine", "label", "floored").select("vec_id", F.round("floored", 6).alias("floored"))


@query("SELECT conv_id, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def w7_latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"))


@query("SELECT conv_id, arg_min(substr(text, 1, 30), turn) FILTER (role = 'user') AS title FROM conversations GROUP BY conv_id")
def w8_first_user_message(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 30)), F.when(F.col("role") == "user", F.col("turn"))).alias("title"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 60")
def w10_trim_newest(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("r")).where("r <= 60").drop("r")


@query("WITH s AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT * FROM conversations WHERE (conv_id * 7 + turn) % 5 <> 0)) SELECT conv_id, turn, turn - before - 1 AS missing FROM s WHERE turn - before > 1")
def w13_sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("(conv_id * 7 + turn) % 5 <> 0").select("conv_id", "turn")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("missing", F.col("turn") - before - 1).where("missing > 0")


@query("SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL")
def w14_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))


@query("WITH h AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) SELECT user_id, rank, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY rank) = 1 THEN 1 ELSE 0 END AS credit FROM h QUALIFY rank <= 10")
def w15_credit_once(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rank"))
    credit = (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("rank")) == 1).cast("int")
    return h.select("user_id", "rank", credit.alias("credit")).where("rank <= 10")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM conversations) WHERE after = 1")
def w16_after_anchor(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, d, "conversations").withColumn("after", F.max((F.col("role") == "assistant").cast("int")).over(w))
    return c.where("after = 1").select("conv_id", "turn")


@query("SELECT user_id, event_id, day IS DISTINCT FROM lag(day) OVER (PARTITION BY user_id ORDER BY t, event_id) AS header FROM (SELECT user_id, event_id, epoch_us(ts) AS t, epoch_us(ts) // 86400000000 AS day FROM events)")
def w17_day_headers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("t"))
    e = e.withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    before = F.lag("day").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return e.select("user_id", "event_id", (~F.col("day").eqNullSafe(before)).alias("header"))


@query("SELECT user_id, event_id, round(1 / (1 + (1706659200000000 - epoch_us(ts)) / 60000000.0 / 30) - 0.02 * (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1), 9) AS score FROM events WHERE event_type = 'signup'")
def w18_recency_score(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'signup'")
    age = (F.lit(1_706_659_200_000_000) - micros("ts")) / 60_000_000.0
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")) - 1
    return e.select("user_id", "event_id", F.round(1 / (1 + age / 30) - 0.02 * place, 9).alias("score"))


@query("SELECT event_id, r FROM (SELECT event_id, row_number() OVER (ORDER BY status DESC NULLS FIRST, event_id) AS r FROM calendar) WHERE r <= 30")
def t4_order_nulls(spark: SparkSession, d: str) -> DataFrame:
    top = P.ordered(calendar(spark, d).select("event_id", "status"), "status", True, ["event_id"]).limit(30)
    return top.select("event_id", F.row_number().over(Window.orderBy(F.col("status").desc_nulls_first(), "event_id")).alias("r"))


@query("WITH p AS (SELECT event_id FROM calendar WHERE title = 'click' ORDER BY starts_us, event_id LIMIT 26 OFFSET 50) SELECT event_id, (SELECT count(*) FROM p) > 25 AS has_more FROM p ORDER BY event_id LIMIT 25")
def t6_offset_page(spark: SparkSession, d: str) -> DataFrame:
    page = calendar(spark, d).where("title = 'click'").orderBy("starts_us", "event_id").offset(50).limit(26).select("event_id")
    more = page.agg((F.count("*") > 25).alias("has_more"))
    return page.join(more, F.lit(True), "cross").orderBy("event_id").limit(25)


@query("SELECT o_orderkey, epoch_us(o_orderdate) AS at_us FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-10' OR (o_orderdate = TIMESTAMP '1996-01-10' AND o_orderkey < 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def t8_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    t = at("1996-01-10")
    after = (F.col("o_orderdate") < t) | ((F.col("o_orderdate") == t) & (F.col("o_orderkey") < 5000))
    return table(spark, d, "orders").where(after).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(21).select("o_orderkey", micros("o_orderdate").alias("at_us"))


@query("SELECT message_id, position FROM (SELECT message_id, position FROM messages WHERE thread_id = 4 ORDER BY sent_us DESC LIMIT 3) ORDER BY position")
def t9_tail_oldest_first(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).where("thread_id = 4").orderBy(F.desc("sent_at")).limit(3).orderBy("sent_at").select("message_id", "position")


@query("SELECT event_id FROM calendar ORDER BY status NULLS FIRST, event_id LIMIT 10")
def t10_nulls_first(spark: SparkSession, d: str) -> DataFrame:
    return calendar(spark, d).orderBy(F.col("status").asc_nulls_first(), "event_id").limit(10).select("event_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents) WHERE upto <= 20000")
def t13_budgeted_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return running_totals(docs, "source", ["n_chars", "doc_id"], "n_chars").where("upto <= 20000").select("source", "doc_id")


@query("WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), walk AS (SELECT source, 0::BIGINT AS i, NULL::BIGINT AS doc_id, 20000::BIGINT AS room, false AS fits FROM (SELECT DISTINCT source FROM d) UNION ALL SELECT d.source, d.i, d.doc_id, CASE WHEN d.n_chars <= w.room THEN w.room - d.n_chars ELSE w.room END, d.n_chars <= w.room FROM walk w JOIN d ON d.source = w.source AND d.i = w.i + 1) SELECT source, doc_id FROM walk WHERE fits")
def t13_greedy_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return greedy_fit(docs, "source", ["doc_id"], "n_chars", 20000).select("source", "doc_id")


@query("SELECT service, count(*) AS n FROM (SELECT 'mail' AS service FROM conversations UNION ALL SELECT 'calendar' FROM events UNION ALL SELECT 'drive' FROM documents) GROUP BY service")
def u1_union_with_tag(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).groupBy(F.lit(s).alias("service")).agg(F.count("*").alias("n")) for t, s in (("conversations", "mail"), ("events", "calendar"), ("documents", "drive"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("WITH a AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS r FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_sort(list_distinct(list_concat(r, ['user', 'guest']))), ',') AS both, array_to_string(list_filter(r, lambda x: x <> 'user'), ',') AS rest, list_has_any(r, ['system']) AS has_system FROM a")
def u3_list_union_except_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("r"))
    more = F.array(F.lit("user"), F.lit("guest"))
    return a.select("conv_id", F.array_join(F.array_sort(F.array_union("r", more)), ",").alias("both"), F.array_join(F.array_except("r", F.array(F.lit("user"))), ",").alias("rest"), F.arrays_overlap("r", F.array(F.lit("system"))).alias("has_system"))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1")
def u6_last_of_batch_wins(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_linenumber", "l_partkey")).alias("x"))
    return last.select("l_orderkey", "x.l_partkey", "x.l_linenumber")


@query("WITH h AS (SELECT doc_id, md5(text) AS h FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS embedded_as FROM h")
def u8_distinct_hashes_fan_back(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    first = stored(h.groupBy("h").agg(F.min("doc_id").alias("embedded_as")), "first")  # read again: a hash of very many rows is split
    return h.join(first, "h").select("doc_id", "embedded_as")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS used, used <= 3 AS allowed FROM events")
def st6_sliding_hour(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("t"))
    used = F.count("*").over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-3_600_000_000, 0))
    return e.select("user_id", "event_id", used.alias("used"), (used <= 3).alias("allowed"))


@query("""WITH r AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, bad ORDER BY t, event_id) AS island FROM r)
SELECT user_id, min(event_id) AS first, count(*) AS failures, CASE WHEN count(*) >= 3 THEN [60, 300, 900, 1800, 3600][least(count(*) - 2, 5)] ELSE 0 END AS pause FROM g WHERE bad GROUP BY user_id, island""")
def st9_failure_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("t"), (F.col("event_type") == "error").alias("bad"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = e.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy("user_id", "bad").orderBy("t", "event_id")))
    runs = e.where("bad").groupBy("user_id", "island").agg(F.min("event_id").alias("first"), F.count("*").alias("failures"))
    # waiting seconds from the third failure on
    ladder = F.lit([60, 300, 900, 1800, 3600])
    pause = F.when(F.col("failures") >= 3, F.element_at(ladder, F.least(F.col("failures") - 2, F.lit(5)).cast("int"))).otherwise(0)
    return runs.select("user_id", "first", "failures", pause.alias("pause"))


@query("SELECT user_id, epoch_us(ts) // 900000000 * 900000000 AS slot, count(*) AS n FROM events GROUP BY ALL")
def st5_tumbling_schedule(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", micros("w.start").alias("slot"), "n")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200000000 THEN 0 ELSE 1 END AS new, event_id FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(t) AS opened, count(*) AS n FROM g GROUP BY user_id, k""")
def st11_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.min(micros("ts")).alias("opened")).select("user_id", "opened", "n")
